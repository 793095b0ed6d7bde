"""Removal of long repeated byte strings by a sparse, hash-compared suffix sort.

A string of ``WINDOW`` bytes that starts in two places holds the same *anchor* in both: the
gram of ``GRAM`` bytes with the least hash among those in it. So only suffixes at anchors are
sorted, about one in forty.

1. Anchors are counted by hash. One that stands once can lie in no repeated string.
2. Where all anchors of a hash also agree in the ``MARGIN`` bytes on both sides, every string
   around them is repeated.
3. The others are dealt and sorted by ranges of (hash, following bytes), of (hash, preceding
   bytes read backwards) and of (hash, both by turns), then by both sides and by row, so that a
   range may end between any two of them. A task takes them in bounded chunks, which a merge
   sort orders; prefix polynomial hashes and binary search give the common extension of two
   suffixes in logarithmic time, and the bytes themselves are compared to rule out collisions.
   Neighbours in these orders share the longest extensions; a pair whose extensions add up to a
   whole string gives a repeated run.
4. A string that its neighbours do not settle (its two sides have different best partners) is
   looked up by its own bytes among the suffixes of its hash that may hold it.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_bloom, long_bloom, record, remembered, slices, stored, tidy

WINDOW = 400
GRAM = 320
MARGIN = WINDOW - GRAM
#: Window starts of one piece of a long text, and bytes hashed together.
_PIECE = 1 << 17
_BUFFER = 1 << 17
#: Bytes of text that a task takes from Arrow into Python at a time.
_SLICE = 1 << 20
#: First sightings of a suffix that a task remembers, to settle copies that it sees itself.
_SIGHTED = 50_000

# Odd multipliers of the polynomial hashes, modulo 2^64, and of the mixer.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(_MIX[0])
    x ^= x >> np.uint64(29)
    x *= np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(32))


class Polynomial:
    """Prefix hashes of a byte array and, from them, the hash of any stretch of it.

    Bytes go through a table of random odd longs, so that texts of few byte values hash well.
    """

    def __init__(self, base: int, size: int) -> None:
        self.table = _mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(base)) | np.uint64(1)
        self.up, self.down = (self._powers(b, size) for b in (base, pow(base, -1, 1 << 64)))

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def stretch(self, prefixes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((prefixes[end] - prefixes[start]) * self.down[start] + (end - start).astype(np.uint64))


def _polynomials() -> tuple[Polynomial, Polynomial]:
    size = _PIECE + _BUFFER + 4 * WINDOW
    return remembered(("polynomials", size), lambda: tuple(Polynomial(b, size) for b in _BASES))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.concatenate((x, np.full(-len(x) % width, np.uint64(2**64 - 1)))).reshape(-1, width)
    before = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    after = np.minimum.accumulate(padded, 1).ravel()
    return np.minimum(before[:n], after[width - 1 : width - 1 + n])


def _pieces(raw: bytes) -> Iterator[tuple[int, int, int, int]]:
    """Cuts of a text: first byte and last, and the window starts that are this piece's own."""
    n = len(raw)
    for start in range(0, n - WINDOW + 1, _PIECE):
        end = min(start + _PIECE, n - WINDOW + 1)
        yield max(0, start - MARGIN), min(n, end + MARGIN + WINDOW), start, end


class Anchors:
    """The anchors of some texts: which text, gram and context hashes, place and context's ends."""

    def __init__(self, raws: list[bytes], cuts: list[tuple[int, int, int, int, int]]) -> None:
        one, two = _polynomials()
        sizes = np.array([b - a for _, a, b, _, _ in cuts])
        at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        self.data = np.frombuffer(b"".join([raws[i][a:b] for i, a, b, _, _ in cuts]), np.uint8)
        prefixes = one.prefixes(self.data)
        starts = np.arange(len(self.data) - GRAM + 1)
        grams = one.stretch(prefixes, starts, starts + GRAM)
        least = _sliding_least(grams, MARGIN + 1)
        own = np.zeros(len(least) + 1, np.int64)
        np.add.at(own, [k + s - a for k, (_, a, _, s, _) in zip(at, cuts)], 1)
        np.add.at(own, [k + e - a for k, (_, a, _, _, e) in zip(at, cuts)], -1)
        least = np.where(np.cumsum(own)[:-1] > 0, least, np.uint64(0))
        edge = np.full(MARGIN, np.uint64(2**64 - 1))
        highest = ~_sliding_least(np.concatenate((edge, ~least, edge)), MARGIN + 1)
        pos = np.flatnonzero(highest == grams)
        piece = np.searchsorted(at, pos, side="right") - 1
        base = at - np.array([a for _, a, _, _, _ in cuts])
        length = np.array([len(raws[i]) for i, *_ in cuts])[piece]
        self.row = np.array([i for i, *_ in cuts])[piece]
        self.place = pos - base[piece]
        self.low = np.maximum(0, self.place - MARGIN)
        self.high = np.minimum(length, self.place + WINDOW)
        self.low_at, self.at, self.high_at = self.low + base[piece], pos, self.high + base[piece]
        second = two.prefixes(self.data)
        whole = two.stretch(second, self.low_at, self.high_at)
        where = (self.place - self.low).astype(np.uint64)
        self.gram = grams[pos].view(np.int64)
        self.gram2 = two.stretch(second, pos, pos + GRAM).view(np.int64)
        self.context = _mix(whole + where * np.uint64(_BASES[0])).view(np.int64)

    def keep(self, which: np.ndarray) -> None:
        for name in ("row", "place", "low", "high", "low_at", "at", "high_at", "gram", "gram2", "context"):
            setattr(self, name, getattr(self, name)[which])

    def bytes(self, start: int, end: int) -> bytes:
        return self.data[start:end].tobytes()


def _anchors(raws: list[bytes]) -> Iterator[Anchors]:
    """All anchors, each once: one that two pieces of a text have found counts for the first."""
    cuts: list[tuple[int, int, int, int, int]] = []
    size = 0
    earlier: dict[int, np.ndarray] = {}  # places found past the end of a text's last piece

    def made() -> Anchors:
        found = Anchors(raws, cuts)
        if earlier:
            again = np.zeros(len(found.row), bool)
            for row, places in earlier.items():
                again |= (found.row == row) & np.isin(found.place, places)
            found.keep(~again)
        earlier.clear()
        for i, _, _, _, e in cuts:
            if e <= len(raws[i]) - WINDOW:
                earlier[i] = found.place[(found.row == i) & (found.place >= e)]
        return found

    for i, raw in enumerate(raws):
        for a, b, s, e in _pieces(raw):
            cuts.append((i, a, b, s, e))
            size += b - a
            if size >= _BUFFER:
                yield made()
                cuts, size = [], 0
    if cuts:
        yield made()


def _raws(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("gram", pa.int64()), ("context", pa.int64())])
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            for found in _anchors(_raws(part)):
                yield record(schema, (found.gram, found.context))


_SETTLED, _ALIKE, _SORTED = 0, 1, 2
_CANDIDATES = (
    "kind int, gram long, context long, gram2 long, id long, hash long, place long, low long,"
    " high long, left binary, right binary, mixed binary"
)
_CANDIDATE_TYPES = pa.schema(
    [("kind", pa.int32()), ("gram", pa.int64()), ("context", pa.int64()), ("gram2", pa.int64()),
     ("id", pa.int64()), ("hash", pa.int64()), ("place", pa.int64()), ("low", pa.int64()),
     ("high", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("mixed", pa.binary())]
)


def _candidates(repeated: np.ndarray, varied: np.ndarray) -> Callable:
    """Rows for anchors that may be repeated, with their sides where contexts vary.

    A context that the task has seen before settles both sightings there and then, and is not
    passed on again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple | None] = {}
        for batch in (part for whole in batches for part in slices(whole, "text", _SLICE)):
            ids, hashes = batch.column("id").to_pylist(), batch.column("hash").to_pylist()
            for found in _anchors(_raws(batch)):
                keep = np.flatnonzero(in_bloom(repeated, found.gram))
                if not len(keep):
                    continue
                vary = in_bloom(varied, found.gram[keep])
                rows = []
                for j, v in zip(keep.tolist(), vary.tolist()):
                    key = (int(found.gram[j]), int(found.context[j]))
                    row = int(found.row[j])
                    where = (ids[row], hashes[row], int(found.place[j]), int(found.low[j]), int(found.high[j]))
                    if key in seen:
                        first = seen[key]
                        if first is not None:
                            rows.append((_SETTLED, *key, 0, *first, None, None, None))
                            seen[key] = None
                        rows.append((_SETTLED, *key, 0, *where, None, None, None))
                        continue
                    if len(seen) >= _SIGHTED:
                        seen.clear()
                    seen[key] = where
                    if v:
                        left = found.bytes(int(found.low_at[j]), int(found.at[j]))[::-1]
                        right = found.bytes(int(found.at[j]) + GRAM, int(found.high_at[j]))
                        rows.append((_SORTED, *key, int(found.gram2[j]), *where, left, right, by_turns(left, right)))
                    else:
                        rows.append((_ALIKE, *key, 0, *where, None, None, None))
                yield record(_CANDIDATE_TYPES, zip(*rows))

    return run


class Suffix:
    """What follows or precedes an anchor, or both by turns, with prefix hashes, and both sides."""

    __slots__ = ("key", "hashes", "left", "right", "tag")

    def __init__(self, side: int, left: bytes, right: bytes, hashes: Sequence[int], tag: tuple) -> None:
        self.key = key_of(side, left, right)
        self.hashes, self.left, self.right, self.tag = hashes, left, right, tag


def key_of(side: int, left: bytes, right: bytes) -> bytes:
    """The bytes that order a suffix: 0 those after it, 1 those before it, backwards, 2 by turns."""
    return (right, left)[side] if side < 2 else by_turns(left, right)


def by_turns(left: bytes, right: bytes) -> bytes:
    """A byte of each in turn while both last, then the rest of the longer."""
    n = min(len(left), len(right))
    out = bytearray(2 * n)
    out[::2], out[1::2] = left[:n], right[:n]
    return bytes(out) + left[n:] + right[n:]


def prefix_hashes(keys: list[bytes]) -> list[array]:
    """Prefix hashes of each key, eight bytes each."""
    one, _ = _polynomials()
    width = max(map(len, keys), default=0)
    table = np.zeros((len(keys), width), np.uint64)
    for i, key in enumerate(keys):
        table[i, : len(key)] = one.table[np.frombuffer(key, np.uint8)]
    out = np.zeros((len(keys), width + 1), np.uint64)
    np.cumsum(table * one.up[:width], axis=1, out=out[:, 1:])
    return [array("Q", row.tobytes()) for row in out]


def extension(a: Suffix, b: Suffix) -> int:
    """Length of the common start, by binary search over prefix hashes; verified on the bytes."""
    low, high = 0, min(len(a.key), len(b.key))
    if low == high or a.key[0] != b.key[0]:
        return 0
    x, y = a.hashes, b.hashes
    if x[high] == y[high]:
        low = high
    while high - low > 1:
        middle = (low + high) >> 1
        if x[middle] == y[middle]:
            low = middle
        else:
            high = middle
    return low if a.key[:low] == b.key[:low] else _plain_extension(a.key, b.key)


def _plain_extension(a: bytes, b: bytes) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def compare(a: Suffix, b: Suffix) -> int:
    n = extension(a, b)
    x, y = a.key[n : n + 1], b.key[n : n + 1]
    if x != y:
        return -1 if x < y else 1
    x, y = (a.left, a.right), (b.left, b.right)
    return (x > y) - (x < y)


def suffix_order(members: list[Suffix]) -> list[Suffix]:
    """Merge sort; a comparison costs the logarithm of the suffixes' length."""
    return sorted(members, key=cmp_to_key(compare))


_EDGE, _PAIR = 0, 1
_ADJACENT = (
    "kind int, part int, side int, gram long, gram2 long, id long, hash long, place long,"
    " l int, r int, left binary, right binary"
)
_ADJACENT_TYPES = pa.schema(
    [("kind", pa.int32()), ("part", pa.int32()), ("side", pa.int32()), ("gram", pa.int64()),
     ("gram2", pa.int64()), ("id", pa.int64()), ("hash", pa.int64()), ("place", pa.int64()),
     ("l", pa.int32()), ("r", pa.int32()), ("left", pa.binary()), ("right", pa.binary())]
)
#: Digests of repeated strings that a look-up task remembers to have told.
_TOLD = 200_000
#: Rows of sorted output passed on at a time.
_OUT = 20_000
#: Suffixes of one hash that a task holds and sorts together.
_CHUNK = 2048


def _pair_rows(group: tuple, a: Suffix, b: Suffix) -> Iterator[tuple]:
    l, r = _plain_extension(a.left, b.left), _plain_extension(a.right, b.right)
    for x in (a, b):
        yield (_PAIR, 0, *group, *x.tag, l, r, None, None)


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of each suffix in its hash's order, and the first and last of the partition.

    Rows come in that order, so a chunk follows on the one before: memory does not depend on how
    many suffixes a hash has.
    """
    part = TaskContext.get().partitionId()
    rows: list[tuple] = []
    group, run = None, []
    first: tuple | None = None
    last: tuple | None = None

    def settle() -> None:
        nonlocal first, last
        if not run:
            return
        hashes = prefix_hashes([key_of(group[0], l, r) for l, r, _ in run])
        order = suffix_order([Suffix(group[0], l, r, h, t) for (l, r, t), h in zip(run, hashes)])
        before = [last[1]] if last is not None and last[0] == group else []
        for a, b in zip(before + order, (before + order)[1:]):
            rows.extend(_pair_rows(group, a, b))
        first = first or (group, order[0])
        last = (group, order[-1])
        run.clear()

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("side", "gram", "gram2", "id", "hash", "place", "left", "right")]
        for side, gram, gram2, id_, hash_, place, left, right in zip(*columns):
            if (side, gram, gram2) != group or len(run) >= _CHUNK:
                settle()
                group = (side, gram, gram2)
                if len(rows) >= _OUT:
                    yield record(_ADJACENT_TYPES, zip(*rows))
                    rows.clear()
            run.append((left, right, (id_, hash_, place)))
    settle()
    for edge in (first, last):
        if edge is not None:
            rows.append((_EDGE, part, *edge[0], *edge[1].tag, 0, 0, edge[1].left, edge[1].right))
    if rows:
        yield record(_ADJACENT_TYPES, zip(*rows))


def _across_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours in different partitions: two rows a partition come here, in the order of parts."""
    edges: list[tuple] = []
    for batch in batches:
        names = ("part", "side", "gram", "gram2", "id", "hash", "place", "left", "right")
        edges.extend(zip(*[batch.column(n).to_pylist() for n in names]))
    rows: list[tuple] = []
    ordered = sorted(range(len(edges)), key=lambda i: (edges[i][0], i))
    made = [(edges[i][1:4], Suffix(edges[i][1], *edges[i][7:9], (), edges[i][4:7]), edges[i][0]) for i in ordered]
    for (ga, a, pa_), (gb, b, pb) in zip(made, made[1:]):
        if ga == gb and pa_ != pb:
            rows.extend(_pair_rows(ga, a, b))
    if rows:
        yield record(_ADJACENT_TYPES, zip(*rows))


_MEMBERS = (
    "gram long, gram2 long, id long, hash long, place long, known array<struct<a:int,b:int>>, open array<int>"
)


def _known_and_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each suffix, which strings around it its neighbours settle and which they leave open.

    A string is told by how many of its bytes precede the anchor. ``known`` are stretches of
    these numbers, ``open`` the others that some partner by the left and some by the right allow.
    """
    stretch = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    schema = pa.schema(
        [("gram", pa.int64()), ("gram2", pa.int64()), ("id", pa.int64()), ("hash", pa.int64()),
         ("place", pa.int64()), ("known", stretch), ("open", pa.list_(pa.int32()))]
    )
    for batch in batches:
        known_of, open_of = [], []
        for sides in batch.column("sides").to_pylist():
            lefts, rights = [s["l"] for s in sides], [s["r"] for s in sides]
            known = sorted((MARGIN - r, l) for l, r in zip(lefts, rights) if l + r >= MARGIN)
            at, top, left_open = max(0, MARGIN - max(rights)), max(lefts), []
            joined: list[list[int]] = []
            for a, b in known:
                left_open += range(at, min(a, top + 1))
                at = max(at, b + 1)
                if joined and a <= joined[-1][1] + 1:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            left_open += range(at, top + 1)
            known_of.append([{"a": a, "b": b} for a, b in joined])
            open_of.append(left_open)
        names = ("gram", "gram2", "id", "hash", "place")
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in names], pa.array(known_of, stretch), pa.array(open_of, pa.list_(pa.int32()))],
            schema=schema,
        )


def _adjacent(sides: DataFrame) -> DataFrame:
    """What neighbours say about each suffix in ``sides`` (candidates of the sorted kind)."""
    columns = ["gram", "gram2", "id", "hash", "place"]
    both = sides.select(*columns, "left", "right", "mixed")
    each = both.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    key = F.when(F.col("side") == 0, F.col("right")).when(F.col("side") == 1, F.col("left")).otherwise(F.col("mixed"))
    order = ["side", "gram", "gram2", "key", "left", "right", "id", "hash", "place"]
    dealt = (
        each.withColumn("key", key)
        .drop("mixed")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )
    found = stored(dealt.drop("key").mapInArrow(tidy(_sorted_runs, "polynomials"), _ADJACENT))
    edges = found.filter(F.col("kind") == _EDGE).coalesce(1).mapInArrow(_across_edges, _ADJACENT)
    pairs = found.filter(F.col("kind") == _PAIR).unionByName(edges)
    merged = pairs.groupBy(*columns).agg(F.collect_set(F.struct("l", "r")).alias("sides"))  # twelve at most
    return merged.mapInArrow(tidy(_known_and_open), _MEMBERS)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the strings asked for that a suffix may share, and which are its own questions.

    One that is no question only tells that the string is repeated, so a task says it once while
    it remembers it; rows come by hash, so that the suffixes of one are in few tasks.
    """
    schema = pa.schema(
        [("own", pa.binary()), ("asks", pa.bool_()), ("id", pa.int64()), ("hash", pa.int64()), ("low", pa.int64())]
    )
    told: set[bytes] = set()
    for batch in batches:
        names = ("gram", "gram2", "id", "hash", "place", "known", "open", "asked", "left", "right")
        rows = []
        for gram, gram2, id_, hash_, place, known, own, asked, left, right in zip(*[batch.column(n).to_pylist() for n in names]):
            mine = set(own)
            for a in asked:
                if a in mine or any(k["a"] <= a <= k["b"] for k in known):
                    text = b"%d %d %d " % (gram, gram2, a) + left[:a] + right[: MARGIN - a]
                    digest = hashlib.blake2b(text, digest_size=16).digest()
                    if a not in mine:
                        if digest in told:
                            continue
                        if len(told) >= _TOLD:
                            told.clear()
                        told.add(digest)
                    rows.append((digest, a in mine, id_, hash_, place - a))
        if rows:
            yield record(schema, zip(*rows))


def _answers(members: DataFrame, sides: DataFrame) -> DataFrame:
    """Open strings that another suffix holds too: ``id, hash, low, high``."""
    columns = ["gram", "gram2"]
    asked = (
        members.select(*columns, F.explode("open").alias("a")).groupBy(*columns)
        .agg(F.collect_set("a").alias("asked"))  # MARGIN + 1 numbers at most
    )
    here = members.join(asked, columns)
    bytes_ = sides.select("id", "hash", "place", "left", "right")
    joined = here.join(bytes_, ["id", "hash", "place"])
    found = joined.repartitionByRange("gram", "gram2", "id", "place").mapInArrow(
        tidy(_looked_up), "own binary, asks boolean, id long, hash long, low long"
    )
    found = stored(found)
    # A digest that is no question stands for a repeated string, even if it comes once.
    shared = (F.count(F.lit(1)) > 1) | ~F.bool_and("asks")
    twice = found.groupBy("own").agg(shared.alias("shared")).filter("shared").select("own")
    return found.filter("asks").join(twice, "own").select("id", "hash", "low", (F.col("low") + WINDOW).alias("high"))


def repeats(docs: DataFrame) -> DataFrame:
    """``id, hash, low, high``: stretches of repeated bytes, overlapping or not.

    ``docs`` has ``id``, ``hash`` (of the text) and ``text``, none null.
    """
    anchors = docs.select("text").mapInArrow(tidy(_count, "polynomials"), "gram long, context long")
    several = (
        anchors.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("context"), F.max("context").alias("other"))
        .filter("n > 1")
    )
    several = stored(several)
    varied = several.filter("context <> other")
    spark = docs.sparkSession
    filters = spark.sparkContext.broadcast((long_bloom(several, "gram"), long_bloom(varied, "gram")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _candidates(*filters.value)(batches)

    found = stored(docs.mapInArrow(tidy(scan, "polynomials"), _CANDIDATES))
    settled = found.filter(F.col("kind") == _SETTLED).select("id", "hash", "low", "high")
    alike = found.filter(F.col("kind") == _ALIKE).join(
        several.filter("context = other").select("gram", "context"), ["gram", "context"]
    ).select("id", "hash", "low", "high")
    sides = found.filter(F.col("kind") == _SORTED)
    members = stored(_adjacent(sides))
    near = members.select("id", "hash", "place", F.explode("known").alias("k")).select(
        "id", "hash", (F.col("place") - F.col("k.b")).alias("low"),
        (F.col("place") - F.col("k.a") + WINDOW).alias("high"),
    )
    answers = _answers(members.filter(F.size("open") + F.size("known") > 0), sides)
    return settled.unionByName(alike).unionByName(near).unionByName(answers)


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching stretches, in order."""
    out: list[list[int]] = []
    for span in sorted((s["low"], s["high"]) for s in spans or ()):
        if out and span[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], span[1])
        else:
            out.append(list(span))
    return [(a, b) for a, b in out]


def kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


_SPANS = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))


def with_spans(docs: DataFrame, finish: Callable, schema) -> DataFrame:
    """What ``finish`` makes of batches of ``row``, ``known``, ``raw`` and ``spans``.

    ``row`` has all columns of ``docs`` but the text, ``raw`` is the text (a null one, not
    ``known``, empty) and ``spans`` its repeated stretches. Rows that repeat in id and text are
    texts of their own: each is repeated in the other. Texts that certainly hold nothing repeated
    (by a filter of bounded size) are not shuffled.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.coalesce("text", F.lit("")).alias("raw"),
        F.col("text").isNotNull().alias("known"),
        F.struct(*[c for c in docs.columns if c != "text"]).alias("row"),
    ).withColumn("hash", F.xxhash64("raw"))
    found = repeats(rows.select("id", "hash", F.col("raw").alias("text")))
    spans = stored(found.groupBy("id", "hash").agg(F.collect_list(F.struct("low", "high")).alias("spans")))
    touched = docs.sparkSession.sparkContext.broadcast(long_bloom(spans, "hash"))

    def split(batches: Iterator[pa.RecordBatch], inside: bool) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "raw", _SLICE)):
            found = in_bloom(touched.value, batch.column("hash").to_numpy())
            yield batch.filter(pa.array(found == inside))

    def asked_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from split(batches, True)

    def clear_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("row", "known", "raw")
        yield from finish(
            pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.nulls(b.num_rows, _SPANS)], names=[*names, "spans"])
            for b in split(batches, False)
        )

    def joined_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from finish(part for whole in batches for part in slices(whole, "raw", _SLICE))

    clear = rows.mapInArrow(tidy(clear_of), schema)
    asked = rows.mapInArrow(tidy(asked_of), rows.schema)
    joined = asked.join(spans, ["id", "hash"], "left").select("row", "known", "raw", "spans")
    return clear.unionByName(joined.mapInArrow(tidy(joined_of), schema))


def summary(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
         ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids, raws = batch.column("row").field(0).to_pylist(), batch.column("raw").cast(pa.binary()).to_pylist()
            for doc, raw, spans in zip(ids, raws, batch.column("spans").to_pylist()):
                runs = merged(spans)
                rest = kept(raw, runs)
                rows.append((doc, len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest()))
            if rows:
                yield record(schema, zip(*rows))

    return with_spans(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), finish,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without their repeated bytes: ``text`` and ``n_chars`` change, nothing else.

    Every copy of a repeated string goes, the first too, as the removal is judged on the input;
    a character of which a byte goes is gone. A null text stays null, a text that is repeated as
    a whole becomes empty, and its row stays.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("raw").cast(pa.binary()).to_pylist()
            known, spans = batch.column("known").to_pylist(), batch.column("spans").to_pylist()
            new = [kept(r, merged(s)).decode("utf-8", "ignore") if k else None for r, s, k in zip(raws, spans, known)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], names=["row", "new"])

    row = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    out = with_spans(docs, finish, docs.select(row, F.col("text").alias("new")).schema)
    columns = {c: F.col("row").getField(c) for c in docs.columns if c != "text"}
    columns |= {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return out.select(*[columns[c].alias(c) for c in docs.columns])


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT r, unnest(range(0, octet_length(b) - 399)) AS i FROM d
), h AS (
  SELECT w.r, i, md5(b[i + 1 : i + 400]) AS h FROM w JOIN d USING (r)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM h) x WHERE n > 1
), starts AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM rep
), runs AS (
  SELECT r, min(i) AS s, max(i) + 400 AS e
  FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM starts) x GROUP BY r, g
), spans AS (
  SELECT r, list({'s': s, 'e': e} ORDER BY s) AS f, count(*) AS k, sum(e - s) AS gone FROM runs GROUP BY r
)
SELECT doc_id, octet_length(b) AS n_bytes, cast(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(k, 0) AS n_spans,
  sha256(CASE WHEN f IS NULL THEN b ELSE list_reduce(list_transform(range(1, len(f) + 2), lambda j:
    b[CASE WHEN j = 1 THEN 1 ELSE f[j - 1].e + 1 END : CASE WHEN j > len(f) THEN octet_length(b) ELSE f[j].s END]),
    lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN spans USING (r)
"""
