"""Ranked lexical search, term at a time with a limited number of accumulators.

Each task takes its documents in blocks, indexes a block's postings in memory and answers every
item of a query block from it: terms go rarest first, and a term's postings make accumulators
only while what the remaining terms can add still reaches the k-th score so far. After that the
survivors alone are brought up to date, exactly, and those that can no longer reach it are
dropped. No posting is shuffled: what leaves a task is at most k documents an item.

The corpus' counts (documents, terms, documents of each asked term) come from a scan of their
own. Items are dealt into query blocks of ``ITEM_TERMS`` terms on average, so what is broadcast
does not grow with the documents nor with the number of items; each block is two narrow scans.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import record, slices, stored

K = 10
#: Terms of all items of one query block, on average.
ITEM_TERMS = 1 << 18
#: Postings and documents of a block that a task indexes.
BLOCK_POSTINGS, BLOCK_DOCS = 1 << 21, 1 << 16
#: Bytes of text split into terms at a time.
_SLICE = 1 << 20
#: The tops of several tasks are merged in so many parts before an item's last merge.
_PARTS = 64
_NO_ID = -(1 << 63)


def _fold() -> bytes:
    """ASCII letters in lower case, digits and bytes of other characters; all else a blank."""
    table = bytearray(b" " * 256)
    table[0x80:] = bytes(range(0x80, 256))
    for byte in b"0123456789abcdefghijklmnopqrstuvwxyz":
        table[byte] = byte
    for byte in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[byte] = byte + 32
    return bytes(table)


_FOLD = _fold()


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text (UTF-8) in order, in runs of about ``_SLICE`` bytes of text."""
    low, at = raw.translate(_FOLD), 0
    while len(low) - at > _SLICE:
        end = low.find(b" ", at + _SLICE)
        if end < 0:
            break
        yield low[at:end].split()
        at = end
    yield (low[at:] if at else low).split()


class Coded:
    """Some documents: their ids, lengths in terms, and counts of known terms by document."""

    __slots__ = ("ids", "length", "doc", "term", "tf")

    def __init__(self, ids: list, length: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        self.ids, self.length, self.doc, self.term, self.tf = ids, length, doc, term, tf


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def coded(batches: Iterator[pa.RecordBatch], codes: dict[bytes, int]) -> Iterator[Coded]:
    """Documents (``id``, ``text``) a slice at a time, with the terms that have a code."""
    size = max(1, len(codes))
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            raws = part.column("text").cast(pa.binary()).to_pylist()
            length = np.zeros(len(raws), np.int64)
            keys, counts = [], []

            def count(held: list[tuple[int, list[bytes]]]) -> None:
                sizes = [len(run) for _, run in held]
                found = chain.from_iterable(run for _, run in held)
                code = np.fromiter(map(codes.get, found, repeat(-1)), np.int64, sum(sizes))
                doc = np.repeat(np.array([d for d, _ in held], np.int64), sizes)
                known = code >= 0
                key, n = np.unique(doc[known] * size + code[known], return_counts=True)
                keys.append(key)
                counts.append(n)

            held: list[tuple[int, list[bytes]]] = []
            waiting = 0
            for i, raw in enumerate(raws):
                for run in terms(raw):
                    length[i] += len(run)
                    waiting += len(run)
                    held.append((i, run))
                    if waiting > _SLICE:
                        count(held)
                        held, waiting = [], 0
            count(held)
            key, tf = _summed(keys, counts)
            yield Coded(part.column("id").to_pylist(), length, key // size, key % size, tf)


class Index:
    """Postings of a block: by term the documents, ascending, and what the term adds to each."""

    def __init__(self, parts: list[Coded], weight: np.ndarray, n: int, total: int) -> None:
        at = np.concatenate(([0], np.cumsum([len(p.ids) for p in parts])))
        self.ids = np.array([i for p in parts for i in p.ids], np.int64)
        length = np.concatenate([p.length for p in parts])
        # Lengths of real corpora fit a long; Python's integers serve where the product does not.
        if int(length.max(initial=0)) * 90 * n < 1 << 63:
            m = 10 + 90 * length * n // max(1, total)
        else:
            m = np.array([10 + 90 * x * n // total for x in length.tolist()], np.int64)
        doc = np.concatenate([p.doc + a for p, a in zip(parts, at)])
        term, tf = (np.concatenate([getattr(p, c) for p in parts]) for c in ("term", "tf"))
        order = np.lexsort((doc, term))
        self.doc, term, tf = doc[order], term[order], tf[order].astype(np.int64)
        self.adds = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]))
        self.start = np.searchsorted(term, np.arange(len(weight) + 1))
        self.most = np.zeros(len(weight), np.int64)
        some = np.flatnonzero(np.diff(self.start))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.adds, self.start[some])

    def search(self, wanted: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers in the block) and scores of all that may be among the k best.

        ``wanted`` are the item's terms, rarest first; ``floor`` a score that the k-th best has
        at least (1 where none is known). Every document of a score that high and not below the
        block's own k-th is returned.
        """
        here = wanted[self.most[wanted] > 0]
        rest = np.append(np.cumsum(self.most[here][::-1])[::-1], 0)
        if not len(here) or rest[0] < floor:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score = np.zeros(len(self.ids), np.int64)
        survivors, turn = None, 0
        while turn < len(here):
            if rest[0] - rest[turn] > rest[turn]:  # else the partial scores cannot exceed the rest
                floor = max(floor, self._kth(score, k))
            if rest[turn] < floor:  # a document not met so far cannot come up to the k-th
                survivors = np.flatnonzero(score >= floor - rest[turn])
                break
            at = slice(self.start[here[turn]], self.start[here[turn] + 1])
            score[self.doc[at]] += self.adds[at]
            turn += 1
        if survivors is None:
            survivors = np.flatnonzero(score >= floor)
        for turn in range(turn, len(here)):
            at = slice(self.start[here[turn]], self.start[here[turn] + 1])
            docs = self.doc[at]
            if len(survivors) * 8 < len(docs):
                place = np.minimum(np.searchsorted(docs, survivors), len(docs) - 1)
                hit = docs[place] == survivors
                score[survivors[hit]] += self.adds[at][place[hit]]
            else:
                score[docs] += self.adds[at]
            floor = max(floor, self._kth(score[survivors], k))
            survivors = survivors[score[survivors] >= floor - rest[turn + 1]]
        return survivors, score[survivors]

    @staticmethod
    def _kth(score: np.ndarray, k: int) -> int:
        return int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0


class Top:
    """The k best documents of one item so far: by score, ties by the smaller id."""

    __slots__ = ("k", "score", "id")

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int:
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.id, ids)), np.concatenate((self.score, scores))
        order = np.lexsort((ids, -scores))[: self.k]
        self.id, self.score = ids[order], scores[order]


def _identified(rows: DataFrame, column: str) -> DataFrame:
    """``id`` (a null one the lowest long) and ``text``, a null text being empty."""
    return rows.select(
        F.coalesce(F.col(column).cast("long"), F.lit(_NO_ID)).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("term", pa.binary())])
    for batch in batches:
        raws = batch.column("text").cast(pa.binary()).to_pylist()
        for item, raw in zip(batch.column("id").to_pylist(), raws):
            found = sorted(set(chain.from_iterable(terms(raw))))
            if found:
                yield record(schema, ([item] * len(found), found))


_DOCUMENTS, _TERMS = -1, -2  # codes under which the corpus' own counts are summed


def _counts(docs: DataFrame, codes: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and documents of each coded term."""
    known = docs.sparkSession.sparkContext.broadcast(codes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(max(1, len(known.value)), np.int64)
        n = total = 0
        for part in coded(batches, known.value):
            df += np.bincount(part.term, minlength=len(df))
            n, total = n + int((part.length > 0).sum()), total + int(part.length.sum())
        some = np.flatnonzero(df)
        codes_ = np.concatenate(([_DOCUMENTS, _TERMS], some))
        yield record(pa.schema([("code", pa.int64()), ("n", pa.int64())]), (codes_, np.concatenate(([n, total], df[some]))))

    sums = docs.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(sums["code"].to_pylist(), sums["n"].to_pylist()))
    df = np.array([found.get(c, 0) for c in range(len(codes))], np.int64)
    return found.get(_DOCUMENTS, 0), found.get(_TERMS, 0), df


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _block(docs: DataFrame, pairs: pa.Table, k: int) -> DataFrame:
    """The tasks' best for the items of one query block: ``item, part, id, score``."""
    codes = {t: i for i, t in enumerate(sorted(set(pairs["term"].to_pylist())))}
    n, total, df = _counts(docs, codes)
    weights = np.array([weight(n, d) for d in df.tolist()], np.int64)
    rarest = np.argsort(df, kind="stable")
    place = np.empty(len(rarest), np.int64)
    place[rarest] = np.arange(len(rarest))
    asked: dict[int, list[int]] = {}
    for item, term in zip(pairs["id"].to_pylist(), pairs["term"].to_pylist()):
        asked.setdefault(item, []).append(codes[term])
    items = [(item, np.array(sorted(found, key=place.__getitem__), np.int64)) for item, found in sorted(asked.items())]
    shared = docs.sparkSession.sparkContext.broadcast((codes, weights, items, n, total))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item", pa.int64()), ("part", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
        codes, weights, items, n, total = shared.value
        tops = [Top(k) for _ in items]

        def answer(parts: list[Coded]) -> None:
            index = Index(parts, weights, n, total)
            for (_, wanted), top in zip(items, tops):
                found, scores = index.search(wanted, top.floor(), k)
                if len(found):
                    top.add(index.ids[found], scores)

        held: list[Coded] = []
        for part in coded(batches, codes):
            held.append(part)
            if sum(len(p.tf) for p in held) >= BLOCK_POSTINGS or sum(len(p.ids) for p in held) >= BLOCK_DOCS:
                answer(held)
                held = []
        if held:
            answer(held)
        task = TaskContext.get().partitionId() % _PARTS
        for (item, _), top in zip(items, tops):
            if len(top.id):
                size = len(top.id)
                yield record(schema, (np.full(size, item), np.full(size, task, np.int32), top.id, top.score))

    return docs.mapInArrow(search, "item long, part int, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item, ties to the smaller id.

    A null text has no terms; a document or item without terms is in no answer. Every row of
    ``docs`` is a document of its own, so a repeated row ranks twice. Rows of one ``item_id``
    are one item with all their terms. Null ids are the lowest and stay null. Scores above 0
    alone are ranked, so an item may have fewer than k rows, or none.
    """
    spark = docs.sparkSession
    rows = _identified(docs, "doc_id")
    asked = stored(_identified(items, "item_id").mapInArrow(_item_terms, "id long, term binary").distinct())
    blocks = -(-asked.count() // ITEM_TERMS)
    found = spark.createDataFrame([], "item long, part int, id long, score long")
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))))
    for block in range(blocks):
        pairs = dealt.filter(F.col("block") == block).select("id", "term").toArrow()
        if len(pairs):
            found = found.unionByName(_block(rows, pairs, k))
    order = [F.desc("score"), F.col("id")]
    first = Window.partitionBy("item", "part").orderBy(*order)
    kept = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).drop("rank")
    last = Window.partitionBy("item").orderBy(*order)
    ranked = kept.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    known = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return ranked.select(
        known("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), known("id").alias("doc_id"), "score"
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), corpus AS (
  SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d
), lengths AS (
  SELECT r, doc_id, 10 + (90 * CAST(len(ts) AS BIGINT) * n) // l AS m FROM d, corpus WHERE len(ts) > 0
), postings AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) x
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * CAST(n AS DOUBLE) + 2) / (2 * CAST(df AS DOUBLE) + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term) x, corpus
), scored AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (r)
  GROUP BY item_id, r, doc_id
), placed AS (
  SELECT item_id, doc_id, score,
    CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
