"""Candidate spans per rule, overlap resolution, and the findings built from them.

A span is ``struct<start, end, prio>`` with code-point offsets and an exclusive end. Field
order makes the natural struct order the positional order.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, running_max, running_sum
from .digits import DIGIT, ascii_digits, known_digits, luhn_ok, rrn_ok
from .rules import (
    JOINED_KEY_BLOCK,
    JOINT,
    RULE_IDS,
    RULES,
    RULES_BY_ID,
    SEVERITIES,
    SEVERITY_RANK,
    Rule,
)

SPAN_TYPE = "array<struct<start:int,end:int,prio:int>>"


def _none() -> Column:
    return F.array().cast(SPAN_TYPE)


def _span(start: Column, end: Column, prio: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), prio.alias("prio")
    )


def _contains(text: Column, mark: str) -> Column:
    return text.rlike(mark[3:]) if mark.startswith("re:") else F.contains(text, F.lit(mark))


def _gate(text: Column, rule: Rule) -> Column:
    """Cheap necessary condition; most documents stop here for every rule."""
    tests = [
        reduce(lambda a, b: a & b, [_contains(text, m) for m in g.split("&")]) for g in rule.gate
    ]
    return reduce(lambda a, b: a | b, tests)


HIT_TYPE = "array<struct<prio:int,value:string,lead:int,used:int>>"


def rule_hits_raw(text: Column, rule: str, joined: bool = False) -> Column:
    """Matches of one rule: matched value, gap before it and characters consumed by it.

    Gaps and consumed lengths give exact offsets later without a position function. A
    look-ahead rule consumes one character per match; a capture ends where its match ends.
    """
    spec, prio, gate = RULES_BY_ID[rule], F.lit(RULE_IDS.index(rule)), _gate(text, RULES_BY_ID[rule])
    if rule not in _NUMBER_RULES:
        # A digit this JVM does not know would look like a word boundary. Gated, so rarely run.
        text = known_digits(text)
    source = JOINED_KEY_BLOCK if joined and rule == "private_key" else spec.pattern
    pattern = F.lit(source)
    group = F.lit(0 if spec.kind in ("match", "cards") else 1)
    gaps = F.split(text, source, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0)) if spec.kind == "capture" else None
    hits = let(
        F.struct(
            F.regexp_extract_all(text, pattern, group).alias("v"),
            gaps.alias("g"),
            (whole if whole is not None else F.lit(None).cast("array<string>")).alias("w"),
        ),
        lambda m: F.transform(
            m["v"],
            lambda v, i: F.struct(
                prio.alias("prio"),
                v.alias("value"),
                F.length(F.get(m["g"], i)).alias("lead"),
                (
                    F.lit(1)
                    if spec.kind == "lookahead"
                    else F.length(F.get(m["w"], i) if whole is not None else v)
                ).alias("used"),
            ),
        ),
    )
    return F.when(gate, hits).otherwise(F.array().cast(HIT_TYPE))


def _card_spans(hit: Column, begin: Column) -> Column:
    """Every Luhn-valid 13-19 digit sub-chain of a chain of digit groups."""

    def body(g: Column) -> Column:
        def starts(o: Column) -> Column:
            def ends(at: Column, i: Column) -> Column:
                tries = F.transform(
                    F.sequence(F.lit(0), F.least(F.lit(18), F.size(g) - 1 - i)),
                    lambda k: F.struct(
                        F.array_join(F.slice(g, i + 1, k + 1), "").alias("digits"),
                        k.alias("seps"),
                    ),
                )
                return F.transform(
                    F.filter(tries, lambda t: luhn_ok(t["digits"])),
                    lambda t: _span(
                        begin + at, begin + at + F.length(t["digits"]) + t["seps"], hit["prio"]
                    ),
                )

            return F.flatten(F.transform(o, ends))

        return let(running_sum(F.transform(g, lambda x: F.length(x) + 1)), starts)

    return let(F.split(ascii_digits(hit["value"]), "[ -]", -1), body)


_CARD, _RRN, _EMAIL = (RULE_IDS.index(r) for r in ("credit_card", "kr_rrn", "email"))


def _spans_of_rule(hits: Column) -> Column:
    """Offsets of one rule's matches, with each rule's own validation applied."""

    def placed(offsets: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            at = F.get(offsets, i) + h["lead"]
            end = F.when(h["prio"] == _EMAIL, at + h["used"]).otherwise(at + F.length(h["value"]))
            return (
                F.when(h["prio"] == _CARD, _card_spans(h, at))
                .when((h["prio"] == _RRN) & ~rrn_ok(h["value"]), _none())
                .otherwise(F.array(_span(end - F.length(h["value"]), end, h["prio"])))
            )

        return F.flatten(F.transform(hits, one))

    return let(running_sum(F.transform(hits, lambda h: h["lead"] + h["used"])), placed)


# Ten possible digits (any character beyond ASCII counts as one) with at most single
# separators, then ten real ones. Every number rule needs both; most text has neither.
_MAYBE = r"[0-9\x{80}-\x{10FFFF}]"
_MAYBE_NUMBER = rf"{_MAYBE}(?:[-\s]?{_MAYBE}){{9}}"
_NUMBER = rf"(?U){DIGIT}(?:[-\s]?{DIGIT}){{9}}"
_NUMBER_RULES = {"kr_rrn", "credit_card", "kr_phone"}


def candidate_spans(
    text: Column, enabled: Iterable[str] | None = None, joined: bool = False
) -> Column:
    """All candidates. A rule left out here cannot shadow another rule's span.

    ``joined`` says the text is several strings put together by ``join_strings``.
    """
    wanted = set(RULE_IDS if enabled is None else enabled)
    none = F.array().cast(f"array<{HIT_TYPE}>")
    words = [rule_hits_raw(text, r, joined) for r in RULE_IDS if r in wanted - _NUMBER_RULES]
    numbers = [r for r in RULE_IDS if r in wanted & _NUMBER_RULES]
    per_rule = F.array(*words) if words else none
    if numbers:
        found = let(
            known_digits(text),
            lambda t: F.when(
                t.rlike(_NUMBER), F.array(*[rule_hits_raw(t, r) for r in numbers])
            ).otherwise(none),
        )
        found = F.when(text.rlike(_MAYBE_NUMBER), found).otherwise(none)
        per_rule = F.concat(per_rule, found)
    return F.flatten(
        F.transform(
            F.filter(per_rule, lambda hits: F.size(hits) > 0), lambda hits: _spans_of_rule(hits)
        )
    )


def resolve_overlaps(spans: Column) -> Column:
    """Greedy keep by (priority, start, end): a span touching a kept one is dropped.

    Spans that meet no other span are kept outright; only the rest go through the fold.
    """

    def dedup(s: Column) -> Column:
        # Equal spans: the stronger rule decides for both, so the weaker copy is redundant.
        return F.filter(
            s,
            lambda x, i: (i == 0)
            | (F.get(s, i - 1)["start"] != x["start"])
            | (F.get(s, i - 1)["end"] != x["end"]),
        )

    def fold(hot: Column) -> Column:
        ranked = F.array_sort(
            F.transform(hot, lambda x: F.struct(x["prio"], x["start"], x["end"]))
        )
        return F.aggregate(
            ranked,
            _none(),
            lambda kept, x: F.when(
                F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])),
                kept,
            ).otherwise(F.concat(kept, F.array(_span(x["start"], x["end"], x["prio"])))),
        )

    def split_hot(s: Column) -> Column:
        def marked(reach: Column) -> Column:
            tagged = F.transform(
                s,
                lambda x, i: F.struct(
                    x.alias("span"),
                    (
                        (F.get(reach, i) > x["start"])
                        | F.coalesce(F.get(s, i + 1)["start"] < x["end"], F.lit(False))
                    ).alias("hot"),
                ),
            )

            def merge(t: Column) -> Column:
                alone = F.transform(F.filter(t, lambda e: ~e["hot"]), lambda e: e["span"])
                hot = F.transform(F.filter(t, lambda e: e["hot"]), lambda e: e["span"])
                return F.array_sort(F.concat(alone, fold(hot)))

            return let(tagged, merge)

        return let(running_max(F.transform(s, lambda x: x["end"])), marked)

    def body(raw: Column) -> Column:
        return F.when(F.size(raw) <= 1, raw).otherwise(
            let(let(F.array_sort(raw), dedup), split_hot)
        )

    return let(spans, body)


# Expressions built so far, per application. Declaring all rules takes a few thousand calls into
# the JVM (about a second), so the expression over a named column is declared once.
_BUILT: dict[tuple, Column] = {}


def kept_spans(
    text: Column | str, enabled: Iterable[str] | None = None, joined: bool = False
) -> Column:
    """Resolved spans in text order; an empty array for NULL or empty text."""
    if isinstance(text, str):
        wanted = None if enabled is None else tuple(sorted(enabled))
        key = (SparkContext._active_spark_context.applicationId, text, wanted, joined)
        if key not in _BUILT:
            _BUILT[key] = kept_spans(F.col(text), wanted, joined)
        return _BUILT[key]
    safe = F.coalesce(text, F.lit(""))
    return resolve_overlaps(candidate_spans(safe, enabled, joined))


def join_strings(strings: Column | str) -> Column:
    """One text in which every string is scanned as if alone.

    The joint is first replaced inside the strings by its neighbour, which rules treat alike.
    """
    return F.array_join(
        F.transform(strings, lambda s: F.replace(s, F.lit(JOINT), F.lit("\x02"))), JOINT
    )


def _by_prio(values: list[str], prio: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), prio + 1)


def rule_name(prio: Column) -> Column:
    return _by_prio(RULE_IDS, prio)


def rules_of(spans: Column) -> Column:
    """Sorted set of rule ids of resolved spans."""
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: rule_name(s["prio"]))))


def rules_in(text: Column | str, enabled: Iterable[str] | None = None) -> Column:
    return rules_of(kept_spans(text, enabled))


def mask(value: Column) -> Column:
    """Keep two characters at each end; short values are fully starred."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(
            F.substr(value, F.lit(1), F.lit(2)),
            F.repeat(F.lit("*"), n - 4),
            F.substr(value, n - 1, F.lit(2)),
        )
    )


def findings_from(text: Column, spans: Column) -> Column:
    def one(s: Column) -> Column:
        value = F.substr(text, s["start"] + 1, s["end"] - s["start"])
        masked = F.when(
            s["prio"] == RULE_IDS.index("private_key"), F.lit("[PRIVATE KEY]")
        ).otherwise(mask(value))
        return F.struct(
            rule_name(s["prio"]).alias("rule"),
            _by_prio([r.label for r in RULES], s["prio"]).alias("label"),
            _by_prio([r.severity for r in RULES], s["prio"]).alias("severity"),
            masked.alias("masked"),
            s["start"].alias("start"),
            s["end"].alias("end"),
        )

    return F.transform(spans, one)


def severity_rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, F.lit(rank)).otherwise(out)
    return out


def max_severity(findings: Column) -> Column:
    """Worst severity of an array of findings, NULL when there are none."""
    worst = F.array_max(F.transform(findings, lambda f: severity_rank(f["severity"])))
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), worst)


def substitute(text: Column, findings: Column, replacement) -> Column:
    """Rebuild ``text`` with ``replacement(finding)`` in place of each finding's span."""

    def body(fs: Column) -> Column:
        pieces = F.transform(
            fs,
            lambda f, i: let(
                F.coalesce(F.get(fs, i - 1)["end"], F.lit(0)),
                lambda prev: F.concat(
                    F.substr(text, prev + 1, f["start"] - prev), replacement(f)
                ),
            ),
        )
        tail = F.substr(text, F.element_at(fs, -1)["end"] + 1, F.length(text))
        return F.when(F.size(fs) == 0, text).otherwise(
            F.concat(F.array_join(pieces, ""), tail)
        )

    return let(findings, body)


def redacted(text: Column, findings: Column) -> Column:
    return substitute(
        text, findings, lambda f: F.concat(F.lit("[REDACTED:"), f["rule"], F.lit("]"))
    )


def preview(text: Column, findings: Column, limit: int = 400) -> Column:
    """Masked text, whitespace collapsed, cut with an ellipsis."""
    flat = F.trim(
        F.regexp_replace(
            substitute(text, findings, lambda f: f["masked"]), r"(?U)[\s\x1c-\x1f]+", " "
        )
    )
    return let(
        flat,
        lambda t: F.when(
            F.length(t) > limit, F.concat(F.substr(t, F.lit(1), F.lit(limit)), F.lit("…"))
        ).otherwise(t),
    )
