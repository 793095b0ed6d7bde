"""Text decoding used by request inspection: media types, percent escapes, JSON and forms.

Each decoder yields NULL for input it cannot vouch for, so callers fail closed by testing NULL.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# Executors need not have this package installed: ship its helpers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Grammar of a media type with parameters.
_TOKEN = r"[!#$%&'*+.^_`|~0-9A-Za-z-]++"
_QUOTED = r'"(?:[\t\x20\x21\x23-\x5b\x5d-\x7e]|\\[\t\x20-\x7e])*+"'
_PARAM = rf"[ \t]*;[ \t]*({_TOKEN})[ \t]*=[ \t]*({_TOKEN}|{_QUOTED})"
MEDIA_KINDS = ["application/json", "text/plain", "application/x-www-form-urlencoded"]
CHARSETS = ["utf-8", "utf8", "us-ascii"]


def language_of(text: Column) -> Column:
    """``ko`` when any Hangul syllable occurs, else ``en``."""
    return F.when(text.rlike("[가-힣]"), F.lit("ko")).otherwise(F.lit("en"))


def media_type(content_type: Column) -> Column:
    """``struct<kind, ascii>`` of one well-formed supported media type, else NULL."""
    value = F.regexp_replace(content_type, r"^[ \t]+|[ \t]+\z", "")

    def body(v: Column) -> Column:
        kind = F.lower(F.regexp_extract(v, rf"\A({_TOKEN}/{_TOKEN})", 1))
        rest = F.regexp_replace(v, rf"\A{_TOKEN}/{_TOKEN}", "")
        names = F.transform(
            F.regexp_extract_all(rest, F.lit(_PARAM), F.lit(1)), lambda n: F.lower(n)
        )
        values = F.regexp_extract_all(rest, F.lit(_PARAM), F.lit(2))
        raw = F.get(values, (F.array_position(names, "charset") - 1).cast("int"))
        bare = F.when(
            F.startswith(raw, F.lit('"')),
            F.regexp_replace(F.substr(raw, F.lit(2), F.length(raw) - 2), r"(?s)\\(.)", "$1"),
        ).otherwise(raw)
        charset = F.lower(F.coalesce(bare, F.lit("utf-8")))
        good = (
            v.rlike(rf"\A{_TOKEN}/{_TOKEN}(?:{_PARAM})*+\z")
            & kind.isin(*MEDIA_KINDS)
            & (F.size(names) == F.size(F.array_distinct(names)))
            & charset.isin(*CHARSETS)
        )
        return F.when(
            good, F.struct(kind.alias("kind"), (charset == "us-ascii").alias("ascii"))
        )

    return let(value, body)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def percent_decode(value: Column, plus: bool = False, ascii_only: Column | bool = False) -> Column:
    """Strict percent-decoding to valid UTF-8; NULL on a bad escape or bad bytes.

    The JVM decoder replaces bad byte sequences by U+FFFD instead of failing, so a result is
    accepted only when it holds no more U+FFFD than the input spelled out.
    """
    source = value if plus else F.replace(value, F.lit("+"), F.lit("%2B"))
    only = F.lit(ascii_only) if isinstance(ascii_only, bool) else ascii_only

    def body(decoded: Column) -> Column:
        spelled = _count(value, "�") + _count(value, "(?i)%EF%BF%BD")
        good = (
            ~value.rlike("%(?![0-9A-Fa-f]{2})")
            & (_count(decoded, "�") == spelled)
            & ~(only & decoded.rlike(r"[^\x00-\x7F]"))
        )
        return F.when(good, decoded)

    return F.when(~value.rlike("[%+]") & ~only, value).otherwise(
        let(F.try_url_decode(source), body)
    )


def looks_json(value: Column) -> Column:
    return value.rlike(r'(?U)\A[\s\x1c-\x1f]*+(?:[{\["]|(?:NaN|-?Infinity)\z)')


# Two private-use marks stand in for escaped backslash and escaped quote while literals are cut.
_SLASH, _QUOTE = "\ue000", "\ue001"
_MARK = "\ue002"
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"


def _shallow(structure: Column, max_depth: int) -> Column:
    """Whether brackets outside string literals nest no deeper than ``max_depth``; an empty pair is
    a value like any other.

    Only a text with more opening brackets than that needs the pass that counts the depth.
    """
    nested = F.regexp_replace(structure, r"\[[ \t\r\n]*+\]|\{[ \t\r\n]*+\}|[^\[\]{}]++", "")
    opened = F.length(F.regexp_replace(nested, r"[\]}]++", ""))
    step = lambda b: F.when(b.isin("[", "{"), 1).otherwise(-1)
    deepest = F.aggregate(
        F.split(nested, ""),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")),
        lambda acc, b: F.struct(
            F.when(b == "", acc["at"]).otherwise(acc["at"] + step(b)).alias("at"),
            F.when(b == "", acc["most"]).otherwise(F.greatest(acc["most"], acc["at"] + step(b))).alias("most"),
        ),
        lambda acc: acc["most"],
    )
    return F.when(opened <= max_depth, F.lit(True)).otherwise(deepest <= max_depth)


def _one_document(text: Column, structure: Column) -> Column:
    """One strict JSON document and nothing after it, its numbers finite.

    The JVM parser is strict but stops after the first document. Inside an array what follows
    could only be told from it if it closed the array or went on in it, inside an object if it
    closed the object or named another key; nothing does both.
    """
    alone = (
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
        & F.try_parse_json(F.concat(F.lit('{"":'), text, F.lit("}"))).isNotNull()
    )
    overflow = F.when(
        structure.rlike(r"[0-9][eE]|[0-9]{300}"),
        F.exists(
            F.regexp_extract_all(structure, F.lit(_NUMBER), F.lit(0)),
            lambda n: F.abs(n.try_cast("double")) == float("inf"),
        ),
    ).otherwise(F.lit(False))
    return alone & ~overflow


def json_strings(text: Column, max_depth: int = 32) -> Column:
    """Every key and string value of a strict JSON document, decoded; NULL if not strict JSON.

    Refused: duplicate keys (also when spelled with escapes), NaN and infinities, trailing
    data, raw control characters, bad escapes, lone surrogates and nesting beyond
    ``max_depth``.
    """
    # A mark already present is respelled as its escape: same string inside a literal, and just
    # as invalid outside one.
    safe = F.replace(
        F.replace(text, F.lit(_SLASH), F.lit("\\ue000")), F.lit(_QUOTE), F.lit("\\ue001")
    )
    marked = F.replace(F.replace(safe, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))

    def body(parts: Column) -> Column:
        literals = F.filter(parts, lambda _p, i: i % 2 == 1)
        structure = F.array_join(F.filter(parts, lambda _p, i: i % 2 == 0), _MARK)
        joined = F.array_join(literals, '","')
        bad = joined.rlike(
            r"[\x00-\x1f]"
            r"|\\(?![/bfnrt]|u[0-9a-fA-F]{4})"
            r"|\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])"
            r"|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F]"
        )
        spelled = F.replace(
            F.replace(joined, F.lit(_QUOTE), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\")
        )
        decoded = F.when(F.size(literals) == 0, F.array().cast("array<string>")).otherwise(
            F.from_json(F.concat(F.lit('["'), spelled, F.lit('"]')), "array<string>")
        )
        good = (
            (F.size(parts) % 2 == 1)
            & ~bad
            & ~structure.rlike(rf"[{_SLASH}{_QUOTE}]")
            & (_count(structure, _MARK) == F.size(literals))
            & _shallow(structure, max_depth)
            & _one_document(text, structure)
        )
        return F.when(good, decoded)

    return let(F.split(marked, '"', -1), body)


def _embedded(parts: list[str], max_depth: int) -> list[str] | None:
    """Strings found by opening JSON-shaped text again and again, or None if any is malformed."""

    def unique(pairs):
        keys = [k for k, _ in pairs]
        if len(set(keys)) != len(keys):
            raise ValueError("duplicate key")
        return pairs, None

    def refuse(_token):
        raise ValueError("not a JSON number")

    def number(token):
        value = float(token)
        if value in (float("inf"), float("-inf")):
            raise ValueError("number out of range")
        return value

    out: list[str] = []
    work: list[tuple[object, int]] = [(p, 0) for p in parts]
    try:
        while work:
            item, depth = work.pop()
            if depth > max_depth:
                return None
            if isinstance(item, str):
                item.encode("utf-8")
                out.append(item)
                head = item.lstrip()
                if head[:1] in ("{", "[", '"') or head in ("NaN", "Infinity", "-Infinity"):
                    tree = json.loads(
                        item, object_pairs_hook=unique, parse_constant=refuse, parse_float=number
                    )
                    work.append((tree, depth + 1))
            elif isinstance(item, tuple):
                for key, value in item[0]:
                    work.append((key, depth + 1))
                    work.append((value, depth + 1))
            elif isinstance(item, list):
                work.extend((value, depth + 1) for value in item)
    except (ValueError, RecursionError):
        return None
    return out


def embedded_strings(max_depth: int = 32):
    """Arrow-batched helper for form fields that themselves hold JSON, nested to any level.

    Only JSON-shaped fields reach it; other rows pass NULL and cost nothing but the null bit.
    """

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for parts in batches:
            yield pd.Series(
                [None if p is None else _embedded(list(p), max_depth) for p in parts],
                dtype=object,
            )

    return run


def form_parts(body: Column, ascii_only: Column, max_fields: int = 1024) -> Column:
    """Decoded keys and values of a form body in order; NULL if any field is malformed."""

    def decode(fields: Column) -> Column:
        pairs = F.flatten(
            F.transform(
                fields,
                lambda f: F.array(
                    F.substring_index(f, "=", 1),
                    F.substr(f, F.instr(f, F.lit("=")) + 1, F.length(f)),
                ),
            )
        )
        whole = (F.size(fields) <= max_fields) & F.forall(
            fields, lambda f: F.contains(f, F.lit("="))
        )
        return F.when(
            whole,
            let(
                F.transform(pairs, lambda p: percent_decode(p, True, ascii_only)),
                lambda parts: F.when(F.forall(parts, lambda p: p.isNotNull()), parts),
            ),
        )

    return let(F.split(body, "&", -1), decode)
