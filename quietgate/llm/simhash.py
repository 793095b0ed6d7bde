"""SimHash near duplicates: BK-trees over the fingerprints, searched within a Hamming radius.

Fingerprints at ``RADIUS`` or fewer differing bits agree in two of six blocks of their bits at
least. So each fingerprint stands in fifteen shards, one for each pair of blocks, and whatever is
linked meets in a shard. A shard is cut into trees of a bounded number of nodes: a child hangs
on its parent by their distance, and a search follows only edges within the radius of its own
distance to the node. Subtrees that are wholly in the searcher's component are not entered, so a
dense cluster costs about its size and not its square.

A shard that needs several trees (a hot one, or one that a partition's end cuts) first links
inside each tree. What then is not in the shard's largest component is sent, in blocks, to every
tree of the shard: the trees are never broadcast to tasks that hold none of their queries, for
all of them together grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import record, slices, stored
from .near import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Bits of the six blocks of a fingerprint, lowest first; two of them name a shard.
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
#: Nodes of one tree, and of the trees that a task holds together.
TREE, FOREST = 4096, 1 << 16
#: Pairs of a searcher and a node looked at together, bytes of text hashed together.
_FRONT, _SLICE = 1 << 18, 1 << 20
#: A fingerprint with more than this share of all rows is joined by broadcast: so many at most.
HOT_FINGERPRINTS = 1000
_NO_ID = -(1 << 63)

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: For each byte its eight bits as eight bytes, so that 255 hashes are summed at once.
_LANES = (((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1))
          << (np.uint64(8) * np.arange(8, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def _runs(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a lower-cased text in runs; each run but the first repeats the last three words."""
    low, at = raw.translate(_LOWER), 0
    last: list[bytes] = []
    several = False
    while True:
        end = at + _SLICE
        while end < len(low) and not low[end : end + 1].isspace():
            end += 1
        found = last + low[at:end].split()
        if len(found) >= SHINGLE:
            yield found
            last, several = found[1 - SHINGLE :], True
        elif end >= len(low) and len(found) > 0 and not several:
            yield found
        else:
            last = found
        if end >= len(low):
            return
        at = end


def _hashes(words: list[bytes]) -> list[int]:
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    starts = np.cumsum([0, *[len(w) + 1 for w in words]]).tolist()
    return [hashed(joined[a : b - 1], SEED) for a, b in zip(starts, starts[SHINGLE:])]


def _bit_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For stretches of hashes of these sizes (none 0): how many have each bit."""
    starts = np.cumsum(sizes) - sizes
    parts = -(-sizes // 255)
    owner = np.repeat(np.arange(len(sizes)), parts)
    first = np.cumsum(parts) - parts
    at = starts[owner] + 255 * (np.arange(len(owner)) - first[owner])
    lanes = _LANES[np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8).T)]
    sums = np.ascontiguousarray(np.add.reduceat(lanes, at, axis=1).T).view(np.uint8)
    return np.add.reduceat(sums.astype(np.int64), first, axis=0)


def fingerprints(raws: list[bytes]) -> np.ndarray:
    """The 64-bit fingerprint of each text (UTF-8): 0 for one without words."""
    counts, n = np.zeros((len(raws), 64), np.int64), np.zeros(len(raws), np.int64)
    held: list[int] = []
    owners: list[int] = []
    sizes: list[int] = []

    def flush() -> None:
        if held:
            np.add.at(counts, owners, _bit_counts(np.array(held, np.uint64), np.array(sizes, np.int64)))
        held.clear(), owners.clear(), sizes.clear()

    for i, raw in enumerate(raws):
        for run in _runs(raw):
            found = _hashes(run)
            if found:
                held.extend(found)
                owners.append(i)
                sizes.append(len(found))
                n[i] += len(found)
            if len(held) >= _SLICE >> 2:
                flush()
    flush()
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("print", pa.int64())])
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            found = fingerprints(part.column("text").cast(pa.binary()).to_pylist())
            yield record(schema, (part.column("id"), found.view(np.int64)))


def shards(print_: Column) -> Column:
    """The fifteen shards of a fingerprint: a pair of blocks each, and the bits in them."""
    starts = np.cumsum((0, *BLOCK_BITS)).tolist()
    blocks = [F.shiftrightunsigned(print_, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, BLOCK_BITS)]
    pairs = [(i, j) for j in range(len(blocks)) for i in range(j)]
    width = max(BLOCK_BITS)
    return F.array(*[
        F.lit(number << 2 * width).cast("long").bitwiseOR(F.shiftleft(blocks[i], width)).bitwiseOR(blocks[j])
        for number, (i, j) in enumerate(pairs)
    ])


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n - 1 the least node that the edges connect each with."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (label[a], label[b], a, b):
            np.minimum.at(new, ends, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


class Forest:
    """BK-trees over fingerprints, one for each run of equal ``tree`` numbers (none twice in one).

    Trees grow together, a level at a time: the first fingerprint of each group is its node, the
    others are grouped by their distance to it. ``links`` are pairs within the radius met so.
    """

    def __init__(self, prints: np.ndarray, tree: np.ndarray, radius: int = RADIUS) -> None:
        n = len(prints)
        self.prints, self.radius = prints, radius
        self.child = np.full((n, 65), -1, np.int32)  # by distance
        todo, group = np.arange(n), np.asarray(tree)
        first = np.concatenate(([True], group[1:] != group[:-1])) if n else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]  # of each fingerprint's tree
        self.levels = [np.flatnonzero(first)]
        self.parent = np.full(n, -1, np.int64)
        links: list[tuple[np.ndarray, np.ndarray]] = []
        while len(todo):
            first = np.concatenate(([True], group[1:] != group[:-1]))
            node = todo[np.flatnonzero(first)[np.cumsum(first) - 1]][~first]
            todo = todo[~first]
            away = np.bitwise_count(prints[todo] ^ prints[node])
            near = away <= radius
            links.append((todo[near], node[near]))
            order = np.lexsort((todo, away, node))
            todo, node, away = todo[order], node[order], away[order].astype(np.int64)
            group = node * 65 + away
            head = np.concatenate(([True], group[1:] != group[:-1])) if len(todo) else np.zeros(0, bool)
            self.child[node[head], away[head]] = todo[head]
            self.parent[todo[head]] = node[head]
            if head.any():
                self.levels.append(todo[head])
        self.links = tuple(np.concatenate(x) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 2

    def uniform(self, label: np.ndarray) -> np.ndarray:
        """For each node the one label of its whole subtree, or -1 if there are several."""
        low, high = label.copy(), label.copy()
        for nodes in reversed(self.levels[1:]):
            np.minimum.at(low, self.parent[nodes], low[nodes])
            np.maximum.at(high, self.parent[nodes], high[nodes])
        return np.where(low == high, low, -1)

    def search(self, prints: np.ndarray, start: np.ndarray, own: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (searcher, node) within the radius and of different labels.

        A searcher has a fingerprint, the root where it starts and a label; labels are not
        negative. Some pairs at a time are looked at, depth first, so memory stays bounded.
        """
        whole = self.uniform(label)
        stack = [(np.arange(a, min(a + _FRONT, len(prints))), start[a : a + _FRONT]) for a in range(0, len(prints), _FRONT)]
        hits = []
        while stack:
            who, node = stack.pop()
            if len(who) > _FRONT:
                half = len(who) // 2
                stack += [(who[:half], node[:half]), (who[half:], node[half:])]
                continue
            enter = whole[node] != own[who]
            who, node = who[enter], node[enter]
            away = np.bitwise_count(prints[who] ^ self.prints[node]).astype(np.int64)
            near = (away <= self.radius) & (own[who] != label[node])
            if near.any():
                hits.append((who[near], node[near]))
            down = []
            for edge in range(-self.radius, self.radius + 1):
                at = away + edge
                inside = np.flatnonzero((at >= 0) & (at <= 64))
                below = self.child[node[inside], at[inside]]
                some = below >= 0
                down.append((who[inside[some]], below[some].astype(np.int64)))
            who, node = (np.concatenate(x) for x in zip(*down))
            if len(who):
                stack.append((who, node))
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*hits))


def linked(prints: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """For each fingerprint the place of the first one that its tree connects it with."""
    forest = Forest(prints, tree)
    a, b = forest.links
    label = least_labels(len(prints), a, b)
    c, d = forest.search(prints, forest.root, label, label)
    return least_labels(len(prints), np.concatenate((a, c)), np.concatenate((b, d))) if len(c) else label


_EDGE, _TREE = 0, 1


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each shard's trees, and the shards that may go on in another tree.

    Rows come by shard. A shard of one fingerprint links nothing.
    """
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def grow(shard: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.concatenate(([True], shard[1:] != shard[:-1]))
        place = np.arange(len(shard)) - np.flatnonzero(start)[np.cumsum(start) - 1]
        cut = start | (place % TREE == 0)
        tree = np.cumsum(cut)
        # A shard is in doubt where it has several trees, and at both ends of what is held.
        ends = np.zeros(len(shard), bool)
        ends[0] = ends[np.flatnonzero(cut)[-1]] = True
        trees = np.flatnonzero(cut & (ends | (place > 0) | np.isin(shard, shard[cut & (place > 0)])))
        yield record(schema, (np.full(len(trees), _TREE), shard[trees], np.zeros(len(trees), np.int64)))
        alone = cut & np.append(cut[1:], True)
        shard, prints, tree = shard[~alone], prints[~alone], tree[~alone]
        if len(prints):
            label = linked(prints.view(np.uint64), tree)
            more = np.flatnonzero(label != np.arange(len(label)))
            yield record(schema, (np.full(len(more), _EDGE), prints[more], prints[label[more]]))

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column("shard").to_numpy(), batch.column("print").to_numpy()))
        size += batch.num_rows
        if size >= FOREST:
            yield from grow(*(np.concatenate(x) for x in zip(*held)))
            held, size = [], 0
    if size:
        yield from grow(*(np.concatenate(x) for x in zip(*held)))


def _packed(rows: DataFrame) -> DataFrame:
    """Fingerprints and labels of a shard (sorted so) in blocks of ``TREE`` at most."""
    names = [("shard", pa.int64()), ("low", pa.int64()), ("prints", pa.binary()), ("labels", pa.binary())]
    schema = pa.schema(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: int | None = None
        held: list[np.ndarray] = []

        def give():
            if held:
                both = np.concatenate(held)
                for at in range(0, len(both), TREE):
                    part = both[at : at + TREE]
                    cells = (shard, int(part[0, 0]), part[:, 0].tobytes(), part[:, 1].tobytes())
                    yield record(schema, [[c] for c in cells])
            held.clear()

        for batch in batches:
            keys = batch.column("shard").to_numpy()
            both = np.stack([batch.column(c).to_numpy() for c in ("print", "label")], 1)
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            for a, b in zip(starts, np.append(starts[1:], len(keys))):
                if int(keys[a]) != shard or sum(map(len, held)) >= TREE:
                    yield from give()
                    shard = int(keys[a])
                held.append(both[a:b])
        yield from give()

    return rows.select("shard", "print", "label").mapInArrow(run, "shard long, low long, prints binary, labels binary")


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components: a block of searchers in a tree of the same shard."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    grown: tuple[bytes, Forest] | None = None
    for batch in batches:
        for row in batch.to_pylist():
            if grown is None or grown[0] != row["prints"]:
                nodes = _numbers(row["prints"]).view(np.uint64)
                grown = (row["prints"], Forest(nodes, np.zeros(len(nodes), np.int64)))
            names, at = np.unique(np.concatenate((_numbers(row["labels"]), _numbers(row["q_labels"]))), return_inverse=True)
            nodes, searchers = len(_numbers(row["labels"])), _numbers(row["q_prints"]).view(np.uint64)
            start = np.zeros(len(searchers), np.int64)
            who, node = grown[1].search(searchers, start, at[nodes:], at[:nodes])
            if len(who):
                pairs = np.unique(np.stack((at[nodes:][who], at[:nodes][node]), 1), axis=0)
                yield record(schema, (names[pairs[:, 0]], names[pairs[:, 1]]))


def _across(keyed: DataFrame, divided: DataFrame, label: DataFrame) -> DataFrame:
    """Links ``a, b`` between components that meet in a shard of several trees.

    Of two fingerprints in different components one is not in the shard's largest: those others
    search all trees of the shard, each block of searchers in each tree in a task of its own.
    """
    rows = keyed.join(divided, "shard").join(label.withColumnRenamed("row", "print"), "print", "left")
    rows = stored(rows.withColumn("label", F.coalesce("label", "print")))
    sizes = rows.groupBy("shard", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("shard").agg(
        F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("several")
    ).filter("several > 1").select("shard", F.col("top.label").alias("most"))
    open_ = rows.join(largest, "shard")
    ordered = lambda df: df.repartitionByRange("shard", "print").sortWithinPartitions("shard", "print")
    trees = stored(_packed(ordered(open_)))
    asking = stored(_packed(ordered(open_.filter("label <> most"))).withColumnsRenamed(
        {"low": "q_low", "prints": "q_prints", "labels": "q_labels"}
    ))
    pairs = asking.select("shard", "q_low").join(trees.select("shard", "low"), "shard")  # of blocks
    return (
        pairs.join(asking, ["shard", "q_low"]).join(trees, ["shard", "low"])
        .select("prints", "labels", "q_prints", "q_labels").mapInArrow(_meet, "a long, b long")
    )


def linked_components(prints: DataFrame) -> DataFrame:
    """``row, label`` of each fingerprint (column ``print``, none twice) that has a link."""
    keyed = prints.select("print", F.explode(shards(F.col("print"))).alias("shard"))
    dealt = keyed.repartitionByRange("shard", "print").sortWithinPartitions("shard", "print")
    found = stored(dealt.select("shard", "print").mapInArrow(_shard_links, "kind int, a long, b long"))
    edges = found.filter(F.col("kind") == _EDGE).select("a", "b")
    if edges.isEmpty():
        label = prints.sparkSession.createDataFrame([], "row long, label long")
    else:
        label = components(edges)
    trees = found.filter(F.col("kind") == _TREE).groupBy(F.col("a").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    divided = trees.filter("n > 1").select("shard")
    more = stored(_across(keyed, divided, label))
    if not more.isEmpty():
        label = components(edges.unionByName(more))
    return label


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id, n_equal`` of every row.

    Fingerprints at ``RADIUS`` or fewer differing bits are linked; a component is named by its
    least ``doc_id`` (null ids are the lowest, and stay null). Null and wordless texts have
    fingerprint 0, which is linked like any other. ``n_equal`` counts rows of the fingerprint.
    """
    rows = stored(
        docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).mapInArrow(_fingerprint, "id long, print long")
    )
    prints = stored(rows.groupBy("print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    label = linked_components(prints.select("print"))
    told = prints.join(label.withColumnRenamed("row", "print"), "print", "left").withColumn("label", F.coalesce("label", "print"))
    names = told.groupBy("label").agg(F.min("least").alias("component"))
    named = stored(told.join(names, "label").select("print", "n", "component"))
    total = rows.count()
    often = F.col("n") * HOT_FINGERPRINTS > total  # fewer than HOT_FINGERPRINTS of them
    hot = named.filter(often).withColumnsRenamed({"n": "hot_n", "component": "hot"})
    here = rows.join(F.broadcast(hot), "print", "left")
    done = here.filter("hot_n is not null").select("id", "print", F.col("hot").alias("component"), F.col("hot_n").alias("n"))
    rest = here.filter("hot_n is null").select("id", "print").join(named.filter(~often), "print")
    null = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return done.unionByName(rest.select("id", "print", "component", "n")).select(
        null("id").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        null("component").alias("component_id"), F.col("n").alias("n_equal"),
    )
