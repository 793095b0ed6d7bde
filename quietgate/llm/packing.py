"""Best-fit packing by exact complements.

What is packed is the table of how many pieces there are of each length: a sequence's gap is
filled exactly by one, two or three lengths where their counts allow, else by the longest that
fits. Each pattern is used as often as the counts allow, so the plan's size depends on the
number of lengths, never on the number of pieces. Pieces then find their place by their rank
among those of their length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .common import record, slices, texts, tidy

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a task remembers: two generations of so many.
_REMEMBERED = 60_000
#: Bytes of text whose words are looked up together.
_SLICE = 1 << 22

# The tokenizer's word pattern, in the characters of _PLAIN.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Text of these characters alone (Latin letters without the odd ones) is normalised by
#: lower() and split(); any other text goes through the tokenizer itself.
_ODD = re.compile("[^\t\n\v\f\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]")
#: No letter, digit or blank: what often follows a word.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Words(dict):
    """Ids of each blank-separated word, as little-endian bytes; forgets the older half."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.model = tokenizer.model
        self.letters = _byte_letters()
        self.older: dict[str, bytes] = {}

    def _keep(self, word: str, found: bytes) -> bytes:
        if len(self) >= _REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        """Ids of one match of the word pattern, remembered as a word of its own."""
        found = self.get(piece) or self.older.get(piece)
        if found is None:
            found = self._keep(piece, self._tokens(piece))
        return found

    def _tokens(self, piece: str) -> bytes:
        coded = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(coded)]).tobytes()

    def _make(self, word: str) -> bytes:
        if word.isalpha():  # one piece as it stands
            return self._tokens(word)
        return b"".join(map(self._piece, _WORD.findall(word)))

    def __missing__(self, word: str) -> bytes:
        return self._keep(word, self.older.get(word) or self._make(word))

    def many(self, words: list[str]) -> list[bytes]:
        """Ids of each of the words; what stands before their closing marks is looked up once."""
        new, older, make = self.get, self.older.get, self._make
        cores = [w.rstrip(_MARKS) for w in words]
        ids = {c: new(c) or older(c) or make(c) for c in set(cores)}
        found = []
        for word, core in zip(words, cores):
            if len(core) == len(word):
                found.append(ids[core])
            elif core[-1:].isalnum():  # marks after a letter or a digit are a piece of their own
                found.append(ids[core] + self[word[len(core) :]])
            else:
                found.append(self[word])
        fresh = list(ids)
        for start in range(0, len(fresh), _REMEMBERED):
            part = fresh[start : start + _REMEMBERED]
            if len(self) + len(part) > _REMEMBERED:
                self.older = dict(self)
                self.clear()
            self.update((w, ids[w]) for w in part)
        return found


def _listed(words: pa.Array) -> list[str]:
    """A list of words without blanks: much faster than one by one."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py().split(" ") if len(words) else []


class Encoder:
    """Ids of a text, exactly as the tokenizer gives them without added special tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.words = Words(self.whole)

    def _plain(self, text: str) -> bool:
        return not (_ODD.search(text) or ("<|" in text and _SPECIAL.search(text)))

    def _whole(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self._plain(text):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.lower().split()))

    def many(self, values: pa.Array) -> Iterator[bytes]:
        """Ids of each of the texts: a word that they repeat is looked up once."""
        plain = np.array([self._plain(v.as_py()) for v in values], bool)
        split = pc.utf8_split_whitespace(pc.utf8_lower(values.filter(pa.array(plain))))
        words = split.flatten().dictionary_encode()
        coded = self.words.many(_listed(words.dictionary))
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        pool, starts = np.frombuffer(b"".join(coded), np.uint32), np.cumsum(size) - size
        at = words.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(size[at])))
        places = np.repeat(starts[at] - ends[:-1], size[at])
        places += np.arange(ends[-1])
        ids = pool[places]
        last = ends[np.cumsum(pc.list_value_length(split).to_numpy())]
        texts = zip(np.concatenate(([0], last)), last)
        for value, simple in zip(values, plain):
            if simple:
                start, end = next(texts)
                yield ids[start:end].tobytes()
            else:
                yield self._whole(value.as_py())


_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ]
)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and a closing 0, cut after every ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)  # of this task: idle workers, which Spark takes in turn, hold none
        step = 4 * capacity
        for batch in batches:
            rows = []
            found = chain.from_iterable(encode.many(part.column("text")) for part in slices(batch, "text", _SLICE))
            for doc, ids in zip(batch.column("doc_id").to_pylist(), found):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield record(_PIECES, zip(*rows))

    ids = F.col("doc_id").cast("long").alias("doc_id")
    return texts(docs).select(ids, "text").mapInArrow(
        tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def _complement(left: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three lengths that are left and sum to the gap: the longest first part wins."""
    if left[gap]:
        return [gap]
    sizes = np.flatnonzero(left[: gap + 1])
    other = gap - sizes
    pair = (other <= sizes) & (left[other] > (other == sizes))
    if pair.any():
        a = int(sizes[pair][-1])
        return [a, gap - a]
    for a in sizes[::-1]:
        a = int(a)
        if 3 * a < gap:
            break
        rest = gap - a
        second = sizes[(sizes <= min(a, rest - 1)) & (2 * sizes >= rest)]
        if not len(second):
            continue
        third = rest - second
        need_a = (second == a).astype(np.int64) + (third == a)
        need_b = 1 + (third == second) + (second == a)
        need_c = 1 + (third == second) + (third == a)
        ok = (left[a] > need_a) & (left[second] >= need_b) & (left[third] >= need_c) & (third > 0)
        if ok.any():
            b = int(second[ok][-1])
            return [a, b, rest - b]
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how often each is used; every counted piece is in exactly one.

    Longest lengths open sequences. A gap is filled exactly where up to three lengths allow;
    else the longest length that fits goes in and the smaller gap is tried again.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    patterns: list[tuple[list[int], int]] = []
    for size in range(capacity, 0, -1):
        while left[size]:
            used = [size]
            left[size] -= 1
            gap = capacity - size
            while gap:
                fill = _complement(left, gap)
                if fill is None:
                    fits = np.flatnonzero(left[: gap + 1])
                    if not len(fits):
                        break
                    fill = [int(fits[-1])]
                for part in fill:
                    used.append(part)
                    left[part] -= 1
                    gap -= part
            parts, need = np.unique(used, return_counts=True)
            more = int(min(left[parts] // need))
            left[parts] -= more * need
            patterns.append((used, 1 + more))
    return patterns


def slots(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: where they start, their first sequence and their offset."""
    taken: dict[int, int] = {}
    rows = []
    sequence = 0
    for used, times in patterns:
        offset = 0
        for part in used:
            rank = taken.get(part, 0)
            rows.append((part, rank, sequence, offset))
            taken[part] = rank + times
            offset += part
        sequence += times
    rows.sort()
    length, rank, first, offset = (np.array(c, np.int64) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 4
    return {"length": length, "rank": rank, "sequence": first, "offset": offset}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, chunks: int | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    A null or empty text is one piece of one id. Repeated rows are packed once each, equal ids
    or not. Only documents longer than ``capacity`` are cut. The pieces (no ids) are stored and
    dealt over ``chunks`` parts, so that pieces of one length, however many, are ranked in many
    tasks; the driver sees one count for each length, ``capacity`` at most.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    parts = chunks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int")
    stored = cut(pieces(docs, path, capacity).withColumn("_chunk", chunk))
    sizes = stored.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = slots(plan(counts, capacity))
    within = Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = (
        stored.join(starts, ["length", "_chunk"])
        .withColumn("_rank", F.col("_from") + F.row_number().over(within) - 1)
        .select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    )
    key = place["length"] << np.int64(44)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            wanted = (batch.column("length").to_numpy() << np.int64(44)) + rank
            at = np.searchsorted(key + place["rank"], wanted, side="right") - 1
            more = [pa.array(place["sequence"][at] + rank - place["rank"][at]), pa.array(place["offset"][at])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *more], names=names)

    return ranked.mapInArrow(
        put,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
