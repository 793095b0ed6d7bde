"""Language identification by a bit-sliced Bloom filter of character n-grams.

Every position of the filter holds a bitmask of languages, in as many words as they need. The masks at an n-gram's positions,
and-ed, are all languages that contain it (and a few that seem to). Popcounts per language over
a text's n-grams, less the false positives expected from the filter's fill, decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import record, slices, stored, texts, tidy

#: Least positions of the filter (a power of two), and hash functions.
POSITIONS_BITS = 19
HASHES = 3
#: The filter has so many positions at least for each n-gram of the language that has most.
POSITIONS_A_GRAM = 8
#: A language has an n-gram if it was seen twice there and is this share of the language's
#: n-grams (so a language has 1 / LEAST_SHARE at most), at this share of the highest rate.
LEAST_SEEN = 2
LEAST_SHARE = 1e-6
LEAST_RATE = 0.1
#: Languages in a word of the masks.
_WORD = 64
#: Bytes of text that are turned into n-grams at a time.
_SLICE = 1 << 18
#: Distinct n-grams that a task holds before it passes them on.
_HELD = 1 << 20

_END = 0xFF  # no byte of UTF-8
#: Letters, and a few signs that count as neither digits nor letters (fractions, circled numbers).
_LETTER_OR_NUMBER = re.compile(r"[^\W\d_]")
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _fold() -> np.ndarray:
    """ASCII letters lower-cased, bytes of other letters kept, all else a space."""
    table = np.full(256, 0x20, np.uint8)
    table[0x80:] = np.arange(0x80, 256)
    for low, up in zip(range(ord("a"), ord("z") + 1), range(ord("A"), ord("Z") + 1)):
        table[low] = table[up] = low
    return table


_FOLD = _fold()


def grams(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Four-byte grams, whether each lies in one text, and where each text's grams start."""
    raw = b" " + b" \xff ".join([v.lower().encode("utf-8", "replace") for v in values]) + b" \xff"
    data = _FOLD[np.frombuffer(raw, np.uint8)]
    space = data == 0x20
    data = data[np.concatenate(([True], ~(space[1:] & space[:-1])))]
    ends = np.flatnonzero(data == _END)
    data = np.concatenate((data, np.full(3, _END, np.uint8))).astype(np.uint32)
    found = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    last = data == _END
    whole = ~(last[:-3] | last[1:-2] | last[2:-1])
    return found, whole, np.concatenate(([0], ends[:-1] + 1))


def has_letter(value: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER_OR_NUMBER.finditer(value))


def positions(found: np.ndarray, hash_number: int, bits: int) -> np.ndarray:
    return ((found.astype(np.uint64) * _ODD[hash_number]) >> np.uint64(64 - bits)).astype(np.int64)


_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _add(old: tuple[np.ndarray, np.ndarray] | None, new: tuple[np.ndarray, np.ndarray]):
    if old is None:
        return new
    keys, at = np.unique(np.concatenate((old[0], new[0])), return_inverse=True)
    counts = np.bincount(at, np.concatenate((old[1], new[1]))).astype(np.int64)
    return keys, counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            langs, values = part.column("lang").to_pylist(), part.column("text").to_pylist()
            for lang in sorted(set(langs)):
                found, whole, _ = grams([v for v, x in zip(values, langs) if x == lang])
                held[lang] = _add(held.get(lang), np.unique(found[whole], return_counts=True))
            if sum(len(k) for k, _ in held.values()) > _HELD:
                yield from (record(_COUNTS, ([x] * len(k), k, n)) for x, (k, n) in held.items())
                held = {}
    yield from (record(_COUNTS, ([x] * len(k), k, n)) for x, (k, n) in held.items())


@dataclass
class LanguageFilter:
    """The learned filter: at each of a power of two of positions a mask of every 64 languages."""

    languages: list[str]  # bit 0 of the first word first; the most frequent language first
    masks: list[np.ndarray]  # one array a word
    rates: np.ndarray | None = None

    def _places(self) -> Iterator[tuple[int, int]]:
        return (divmod(i, _WORD) for i in range(len(self.languages)))

    def false_rates(self) -> np.ndarray:
        """For each language, how likely an n-gram that it lacks seems to be in it. Told once."""
        if self.rates is not None:
            return self.rates
        one = [m.dtype.type(1) for m in self.masks]
        bits = [float(np.mean((self.masks[w] >> one[w].dtype.type(i)) & one[w] != 0)) for w, i in self._places()]
        self.rates = np.array(bits) ** HASHES
        return self.rates

    def score(self, values: list[str]) -> list[tuple[str, float, float]]:
        """For each text: language, its share of all corrected counts, its share of the n-grams.

        ``und`` for a text without a letter. A text none of whose n-grams is known gets the most
        frequent language at score 0; ties go to the more frequent language.
        """
        if not values:
            return []
        if not self.languages:
            return [("und", 0.0, 0.0)] * len(values)
        found, whole, starts = grams(values)
        bits = len(self.masks[0]).bit_length() - 1
        at = [positions(found, i, bits) for i in range(HASHES)]
        seen = np.empty((len(values), len(self.languages)), np.int64)
        for w, table in enumerate(self.masks):
            masks = table[at[0]]
            for more in at[1:]:
                masks &= table[more]
            masks[~whole] = 0
            kind = masks.dtype.type
            for i in range(w * _WORD, min((w + 1) * _WORD, len(self.languages))):
                seen[:, i] = np.add.reduceat((masks >> kind(i % _WORD)) & kind(1), starts, dtype=np.int64)
        total = np.add.reduceat(whole, starts, dtype=np.int64)
        false = self.false_rates()
        clean = np.maximum(0.0, seen - total[:, None] * false) / (1 - np.minimum(false, 0.999))
        best = clean.argmax(axis=1)
        top = clean[np.arange(len(values)), best]
        share = top / np.maximum(clean.sum(axis=1), 1e-12)
        cover = np.minimum(1.0, top / np.maximum(total, 1))
        return [
            (self.languages[b], min(1.0, float(s)), float(c)) if has_letter(v) else ("und", 0.0, 0.0)
            for v, b, s, c in zip(values, best, share, cover)
        ]


def fit(train: DataFrame) -> LanguageFilter:
    """Learn from every row of ``text, lang``; rows with either null teach nothing.

    The counts of all n-grams are summed in Spark; what reaches the driver is a few counts for
    each language and one mask for each filled position and word of the filter, whose size
    follows from the n-grams learned: 2^23 positions at most.
    """
    rows = train.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), "text"
    )
    totals = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    names = [r["lang"] for r in totals.orderBy(F.desc("docs"), "lang").collect()]
    if not names:
        return LanguageFilter([], [])
    counts = stored(
        rows.mapInArrow(tidy(_count), "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    sums = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    known = train.sparkSession.createDataFrame(
        [(x, i, max(1, sums.get(x, 0))) for i, x in enumerate(names)], "lang string, i int, total long"
    )
    rate = F.col("n") / F.col("total")
    top = F.max("rate").over(Window.partitionBy("gram"))  # one row a language
    learned = stored(
        counts.join(known, "lang").withColumn("rate", rate).withColumn("top", top)
        .filter(
            (F.col("n") >= LEAST_SEEN) & (F.col("rate") >= LEAST_SHARE) & (F.col("rate") >= LEAST_RATE * F.col("top"))
        )
        .select("gram", "i")
    )
    most = max((r["count"] for r in learned.groupBy("i").count().collect()), default=0)
    bits = max(POSITIONS_BITS, (POSITIONS_A_GRAM * most - 1).bit_length() if most else 0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("at", pa.int64()), ("word", pa.int32()), ("mask", pa.int64())])
        for batch in batches:
            found, i = batch.column("gram").to_numpy(), batch.column("i").to_numpy()
            mask = (np.uint64(1) << (i % _WORD).astype(np.uint64)).view(np.int64)
            for k in range(HASHES):
                yield record(schema, (positions(found, k, bits), i // _WORD, mask))

    filled = (
        learned.mapInArrow(place, "at long, word int, mask long")
        .groupBy("at", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    )
    at, word, mask = (filled[c].to_numpy() for c in ("at", "word", "mask"))
    tables = []
    for w in range(0, len(names), _WORD):
        kind = next(k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if min(len(names) - w, _WORD) <= n)
        table, here = np.zeros(1 << bits, kind), word == w // _WORD
        table[at[here]] = mask[here].astype(np.uint64).astype(kind)
        tables.append(table)
    return LanguageFilter(names, tables)


_PREDICTED = [("lang_pred", pa.string()), ("score", pa.float64()), ("coverage", pa.float64())]


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred, score, coverage``, from ``text`` alone.

    A null text, or one without a letter, is ``und`` at 0. Columns of the same names are
    replaced. One narrow stage; the filter is broadcast (its size is bounded, see :func:`fit`).
    """
    known = docs.sparkSession.sparkContext.broadcast((model.languages, model.masks))
    kept = docs.drop(*[n for n, _ in _PREDICTED])
    schema = kept.withColumns(
        {"lang_pred": F.lit(""), "score": F.lit(0.0), "coverage": F.lit(0.0)}
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = LanguageFilter(*known.value)
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                found = learned.score([v or "" for v in part.column("text").to_pylist()])
                more = [pa.array(c, t) for c, (_, t) in zip(zip(*found), _PREDICTED)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *more], names=[*part.schema.names, *[n for n, _ in _PREDICTED]]
                )

    return kept.mapInArrow(tidy(run), schema)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id is in no fold (null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


#: A text of which fewer n-grams belong to its language is rejected by :func:`known_language`.
LEAST_COVERAGE = 0.05


def known_language(docs: DataFrame, model: LanguageFilter, least: float = LEAST_COVERAGE) -> DataFrame:
    """The documents in a learned language: texts without letters or of unknown n-grams go.

    Columns and values of the rows kept are unchanged.
    """
    known = docs.sparkSession.sparkContext.broadcast((model.languages, model.masks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = LanguageFilter(*known.value)
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                found = learned.score([v or "" for v in part.column("text").to_pylist()])
                yield part.filter(pa.array([lang != "und" and cover >= least for lang, _, cover in found]))

    return docs.mapInArrow(tidy(run), docs.schema)
