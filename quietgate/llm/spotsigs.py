"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

DataFrame functions alone; nothing runs in Python.

* Words are runs of letters and digits of the lower-cased text. A common word is an anchor; so
  is the text's start, and every sixth content word of a stretch without one (tables, junk).
* A signature is the hash of the ``CHAIN`` content words (fewer at the text's end) after an
  anchor; anchors next to each other are one. A text of common words alone has one signature,
  of all of them; a text without words has none.
* A fingerprint is the sorted set of signatures. Likeness is the Jaccard ratio of two sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, texts

# The most common function words of English, German, French and Spanish.
COMMON = tuple(
    "a an and are as at be but by can for from had has have he her his i if in is it its not of "
    "on or she that the their they this to was we were what which who will with would you "
    "als am auf aus bei das dass dem den der des die du ein eine einem einen einer er es für hat "
    "ich ihr im ist mit nach nicht noch sein sich sie sind so über um und von vor war wie wir zu "
    "zum zur au aux avec ce ces cette dans de elle en est et il je la le les leur lui mais ne "
    "nous ou par pas plus pour qu que qui sa se ses son sont sur un une vous al como con del el "
    "ella los las lo más mi no para pero por se ser su sus también te todo una unos y".split()
)
CHAIN = 3
#: In a stretch without common words, every so many content words make an anchor.
STRETCH = 6
MARK = "\x01"
#: Stands for a null id.
_NO_ID = -(1 << 63)


def _trie(words: list[str]) -> str:
    """A pattern for the words that branches by their letters, so that few branches are tried."""
    ends = "" in words
    heads = sorted({w[0] for w in words if w})
    arms = [h + _trie([w[1:] for w in words if w[:1] == h]) for h in heads]
    if not arms:
        return ""
    body = arms[0] if len(arms) == 1 and not ends else "(?:" + "|".join(arms) + ")"
    return body + ("?" if ends else "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signatures(text: Column) -> Column:
    """The sorted distinct signatures (longs) of a text; null for a null text."""
    trimmed = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.array_sort(_let(F.concat(F.lit(" "), trimmed, F.lit(" ")), _of_words))


def _of_words(words: Column) -> Column:
    """Distinct signatures of words, each between blanks."""
    marked = F.concat(F.lit(MARK), F.regexp_replace(words, rf" {_trie(sorted(set(COMMON)))}(?= )", MARK))
    marked = F.regexp_replace(marked, rf"((?: [^ {MARK}]++){{{STRETCH}}})(?= [^ ])", "$1" + MARK)
    chain = rf"{MARK}(?=((?: [^ {MARK}]++{MARK}*+){{1,{CHAIN}}}))"
    found = F.transform(
        F.array_distinct(F.regexp_extract_all(marked, F.lit(chain), 1)),
        lambda x: F.xxhash64(F.translate(x, MARK, "")),
    )
    alone = F.when(F.trim(words) != "", F.array(F.xxhash64(words))).otherwise(F.array().cast("array<long>"))
    return _let(found, lambda x: F.when(F.size(x) > 0, F.array_distinct(x)).otherwise(alone))


def spelled(signs: Column) -> Column:
    """A fingerprint as text: the signatures in hexadecimal, in order."""
    return F.array_join(F.transform(signs, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), " ")


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Likeness of two signature sets, 1 for two empty ones.

    The sets' lengths alone bound it by smaller over larger: below ``least`` nothing is compared
    and the result is 0.
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    ratio = _let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))
    return (
        F.when(large == 0, F.lit(1.0))
        .when((small == 0) | (small < large * F.lit(least)), F.lit(0.0))
        .otherwise(ratio)
    )


def length_class(size: Column, least: float) -> Column:
    """Partition of set lengths: sets of likeness ``least`` are in the same or next class."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / F.lit(-math.log(least))).cast("int")


def near_pairs(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs ``a, b, likeness`` of different fingerprints with a likeness of ``least`` or more.

    ``prints`` has one row per class: ``id`` and ``signs``, distinct and not empty. Length
    partitions: a set meets those of its own and the next length class only. Pruning: within a
    class, sets meet by their rarest signatures (ties by value), as many as must hold a common
    one; lengths and overlap then bound the rest. Common signatures are never a join key unless
    a set has no rarer ones, and nothing is paired with all of its group.
    """
    each = prints.select("id", F.size("signs").alias("n"), F.explode("signs").alias("sign"))
    often = each.groupBy("sign").agg(F.count(F.lit(1)).alias("often"))
    rare = (
        each.join(often, "sign")
        .groupBy("id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("often", "sign"))).alias("by"))
    )
    must = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1
    prefix = rare.select(
        "id", "n", length_class(F.col("n"), least).alias("part"),
        F.explode(F.slice("by", F.lit(1), must.cast("int"))).alias("s"),
    ).select("id", "n", "part", F.col("s.sign").alias("sign"))
    twice = prefix.groupBy("sign").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("sign")
    prefix = prefix.join(twice, "sign", "left_semi")
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "part", "sign")
    right = prefix.select(
        F.col("id").alias("b"), F.col("n").alias("nb"), "sign",
        F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"),
    )
    ok = (F.col("a") != F.col("b")) & (
        F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(least) - 1e-9
    )
    met = left.join(right, ["part", "sign"]).filter(ok)
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a = prints.select(F.col("id").alias("a"), F.col("signs").alias("sa"))
    b = prints.select(F.col("id").alias("b"), F.col("signs").alias("sb"))
    scored = pairs.join(a, "a").join(b, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb"), least).alias("likeness"))
    return scored.filter(F.col("likeness") >= least - 1e-12)


def edited(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document.

    The next document is the one before in ``doc_id`` (a null id is the lowest; equal ids go by
    their text's hash); the last has the first as its next, a document alone itself. Rows that
    repeat in id and text count once in that order and are answered alike. The edited text ends
    with the first floor(n/3) code points of the next one (or all) instead of its own last
    floor(n/3). A null text is empty. Columns: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_signatures``.

    Ids and lengths alone are ranked. Texts are dealt once, by id and hash, for both joins; the
    heads that their neighbours take, a third of them at most, once more. Signatures are made
    again on each side rather than dealt with the texts.
    """
    rows = texts(docs).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"), F.xxhash64("text").alias("_hash"), "text"
    )
    narrow = rows.select("_id", "_hash", F.floor(F.length("text") / 3).alias("_third")).distinct()
    at = ranked(narrow, [F.col("_id").desc(), F.col("_hash")], "_at")
    n = at.count()
    takes = at.select(
        ((F.col("_at") + 1) % F.lit(max(n, 1))).alias("_at"),
        F.col("_id").alias("_to_id"), F.col("_hash").alias("_to_hash"), F.col("_third").alias("_take"),
    )
    links = at.join(takes, "_at").select("_id", "_hash", "_to_id", "_to_hash", "_take")
    heads = (
        rows.join(links, ["_id", "_hash"])
        .select(
            F.col("_to_id").alias("_id"), F.col("_to_hash").alias("_hash"),
            F.substring("text", F.lit(1), F.col("_take").cast("int")).alias("_head"),
            signatures(F.col("text")).alias("_next_signs"),
        )
        .groupBy("_id", "_hash")
        .agg(F.first("_head").alias("_head"), F.first("_next_signs").alias("_next_signs"))
    )
    size = F.length("text")
    kept = F.substring("text", F.lit(1), (size - F.floor(size / 3)).cast("int"))
    both = rows.join(heads, ["_id", "_hash"]).select(
        F.when(F.col("_id") != _NO_ID, F.col("_id")).alias("doc_id"),
        size.cast("long").alias("n_chars"), signatures(F.col("text")).alias("signs"), "_next_signs",
        F.concat(kept, F.col("_head")).alias("_edited"),
    )
    both = both.withColumn("_edited_signs", signatures(F.col("_edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        spelled(F.col("signs")).alias("fingerprint"),
        spelled(F.col("_edited_signs")).alias("edited_fingerprint"),
        jaccard(F.col("signs"), F.col("_edited_signs")).alias("near_edited"),
        jaccard(F.col("signs"), F.col("_next_signs")).alias("near_next"),
        F.size("signs").alias("n_signatures"),
    )
