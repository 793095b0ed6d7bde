"""Exact top-k inner products by distributed histogram selection.

Every query is scored against every vector, block by block. Histograms of the scores, summed
over all blocks, are refined around each query's k-th value until its bin holds that one value;
scores above it, and the smallest ids at it, are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .common import record

K = 10
SCALE = 1024
#: Bins of one histogram, queries and vectors of one block.
BINS_BITS = 10
QUERY_BLOCK = 256
VECTOR_BLOCK = 2048
#: A scaled component beyond this takes exact Python integers instead of doubles.
_EXACT = float(1 << 53)
_LONG = float(1 << 63)
_MOST = (1 << 63) - 1


def _scaled(x: Column) -> Column:
    y = x.cast("double") * SCALE
    whole = (y >= -_LONG) & (y < _LONG)
    return F.when(whole, F.floor(y).cast("long")).otherwise(
        F.raise_error(F.lit("a scaled component is no long")).cast("long")
    )


def scaled(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, dim, x``: floor(1024 * component) as longs, vectors with a null or non-finite
    component (or null, or with a null id) left out. Raises if a scaled component is no long."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.filter(F.col(vector).isNotNull() & F.col("vec_id").isNotNull() & ~bad)
    return usable.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.size(vector).alias("dim"),
        F.transform(vector, _scaled).alias("x"),
    )


def _blocks(rows: DataFrame, group: str, size: int) -> DataFrame:
    """Rows of one group packed: ids and components as bytes, ``size`` vectors at most a block."""
    schema = f"{group} int, dim int, n int, ids binary, xs binary, top double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [(group, pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("xs", pa.binary()), ("top", pa.float64())]
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def give(key):
            ids = np.concatenate([i for i, _ in held[key]])
            xs = np.concatenate([x for _, x in held.pop(key)])
            for at in range(0, len(ids), size):
                part = xs[at : at + size]
                top = float(np.abs(part.astype(np.float64)).max()) if part.size else 0.0
                cells = (*key, len(part), ids[at : at + size].tobytes(), part.tobytes(), top)
                yield record(pa.schema(names), [[c] for c in cells])

        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            lists = batch.column("x")
            keys = np.stack([batch.column(group).to_numpy(), batch.column("dim").to_numpy()], 1)
            for group_id, dim in np.unique(keys, axis=0):
                at = np.flatnonzero((keys == (group_id, dim)).all(axis=1))
                flat = lists.take(pa.array(at)).flatten().to_numpy().astype(np.int64).reshape(len(at), dim)
                key = (int(group_id), int(dim))
                held.setdefault(key, []).append((ids[at], flat))
                if sum(len(i) for i, _ in held[key]) >= size:
                    yield from give(key)
        for key in list(held):
            yield from give(key)

    return rows.select(group, "vec_id", "dim", "x").mapInArrow(run, schema)


def _scores(row: dict) -> np.ndarray:
    """Integer inner products of a query block (rows) and a vector block (columns)."""
    q = np.frombuffer(row["q_xs"], np.int64).reshape(row["q_n"], row["dim"])
    v = np.frombuffer(row["xs"], np.int64).reshape(row["n"], row["dim"])
    if row["q_top"] * row["top"] * row["dim"] < _EXACT:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ v.astype(object).T if row["dim"] else np.zeros((len(q), len(v)), object)
    if exact.size and not -_MOST <= int(exact.min()) <= int(exact.max()) <= _MOST:
        raise ValueError("a score is no long")
    return exact.astype(np.int64)


def _candidates(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, vector ids, scores, and which pairs are not a row and its own id."""
    queries, vectors = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    return queries, vectors, _scores(row), queries[:, None] != vectors[None, :]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, groups: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all vectors for each query.

    Both frames come from :func:`scaled`. A query's own id is no candidate; ties go to the
    smaller id; vectors of another length are no candidates. A query with fewer candidates gets
    them all, one with none has no row. A repeated row is a candidate each time; a repeated
    query is answered once for each id. Raises if a score is no long.

    Vectors are dealt evenly over ``groups`` parts, whatever their values, and query blocks go
    to every part. Each round passes one histogram a query and task; at the k-th score a task
    passes at most k ids, for no more of its own can be in the answer.
    """
    spark = vectors.sparkSession
    parts = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    held = cut(_blocks(vectors.withColumn("part", own).repartition(parts, "part"), "part", VECTOR_BLOCK))
    asked = queries.dropDuplicates(["vec_id"])
    n_queries = asked.count()
    if n_queries == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q_parts = -(-n_queries // QUERY_BLOCK)
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_parts)).cast("int")
    packed = _blocks(asked.withColumn("q_part", block).repartition("q_part"), "q_part", QUERY_BLOCK)
    packed = cut(packed.select("q_part", "dim", F.md5("ids").alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in ("n", "ids", "xs", "top")]))
    bound = packed.select("dim", F.col("q_top").alias("top")).groupBy("dim").agg(F.max("top").alias("a")).join(
        held.groupBy("dim").agg(F.max("top").alias("b")), "dim"
    ).agg(F.max(F.col("a") * F.col("b") * F.col("dim"))).first()[0]
    reach = min(int((bound or 0) * 1.001) + 1, _MOST)  # every score is within -reach .. reach
    bits = (2 * reach).bit_length()

    # Of each query: the lowest score of the bin that holds its k-th, and how many are above it.
    state = asked.select(F.col("vec_id").alias("query_id"), F.lit(-reach).alias("low"), F.lit(0).cast("long").alias("above"))
    shift = bits
    while shift > 0:
        width, shift = shift, max(0, shift - BINS_BITS)
        state = cut(_refine(_pairs(held, packed, state, parts), state, width, shift, k))
    return _answers(_pairs(held, packed, state, parts), k)


def _pairs(held: DataFrame, packed: DataFrame, state: DataFrame, parts: int) -> DataFrame:
    """Each block of vectors with each block of queries and its queries' states, in their order.

    States join the query blocks, which are few, before those go to every part.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("q_block", pa.string()), ("at", pa.int32()), ("query_id", pa.int64())])
        for batch in batches:
            for block, ids in zip(batch.column("q_block").to_pylist(), batch.column("q_ids").to_pylist()):
                each = np.frombuffer(ids, np.int64)
                yield record(schema, ([block] * len(each), np.arange(len(each), dtype=np.int32), each))

    rows = packed.select("q_block", "q_ids").mapInArrow(unpack, "q_block string, at int, query_id long")
    states = rows.join(state, "query_id").groupBy("q_block").agg(  # a block's queries, at most QUERY_BLOCK
        F.array_sort(F.collect_list(F.struct("at", "low", "above"))).alias("state")
    )
    told = packed.join(states, "q_block").withColumns({"low": F.col("state.low"), "above": F.col("state.above")})
    spread = told.drop("state").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return held.join(spread, ["part", "dim"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _refine(pairs: DataFrame, state: DataFrame, width: int, shift: int, k: int) -> DataFrame:
    """One round: 2^(width - shift) bins over each query's bin of 2^width scores."""
    bins = 1 << (width - shift)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("bin", pa.int32()), ("n", pa.int64())])
        sums: dict[bytes, np.ndarray] = {}

        def give():
            for ids, table in sums.items():
                at, bin_ = np.nonzero(table)
                yield record(schema, (np.frombuffer(ids, np.int64)[at], bin_, table[at, bin_]))
            sums.clear()

        for row in _rows(batches):
            queries, _, score, other = _candidates(row)
            low = np.array(row["low"], np.int64)[:, None]
            at = score.view(np.uint64) - low.view(np.uint64)  # modulo 2^64, right where score >= low
            inside = other & (score >= low) & (at <= np.uint64((1 << width) - 1))
            slot = (at >> np.uint64(shift)).astype(np.int64) + (np.arange(len(queries)) * bins)[:, None]
            n = np.bincount(slot[inside], minlength=len(queries) * bins).reshape(len(queries), bins)
            sums[row["q_ids"]] = sums.get(row["q_ids"], 0) + n
            if len(sums) >= 16:
                yield from give()
        yield from give()

    counted = pairs.mapInArrow(count, "query_id long, bin int, n long")
    summed = counted.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    summed = summed.withColumn("upto", F.sum("n").over(down)).withColumn(
        "lowest", F.min("bin").over(Window.partitionBy("query_id"))
    )
    joined = summed.join(state, "query_id")
    wide = lambda c: c.cast("decimal(19,0)")
    before = F.col("above") + F.col("upto") - F.col("n")
    holds = (before < k) & ((F.col("above") + F.col("upto") >= k) | (F.col("bin") == F.col("lowest")))
    return joined.filter(holds).select(
        "query_id", (wide(F.col("low")) + wide(F.col("bin")) * wide(F.lit(1 << shift))).cast("long").alias("low"), before.alias("above")
    )


def _answers(pairs: DataFrame, k: int) -> DataFrame:
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        ties: dict[int, np.ndarray] = {}
        kth: dict[int, int] = {}
        for row in _rows(batches):
            queries, vectors, score, other = _candidates(row)
            low = np.array(row["low"], np.int64)
            at, col = np.nonzero(other & (score > low[:, None]))
            if len(at):
                yield record(schema, (queries[at], vectors[col], score[at, col]))
            at, col = np.nonzero(other & (score == low[:, None]))
            for i in np.unique(at):
                query = int(queries[i])
                need = max(0, k - row["above"][i])
                same = np.concatenate((ties.get(query, np.zeros(0, np.int64)), vectors[col[at == i]]))
                ties[query] = np.sort(same)[:need]
                kth[query] = int(low[i])
        for query, ids in ties.items():
            if len(ids):
                yield record(schema, (np.full(len(ids), query), ids, np.full(len(ids), kth[query])))

    found = pairs.mapInArrow(pick, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ordered = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ordered.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(vectors: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """The stated query set: rows whose ``vec_id`` is divisible by ``every``."""
    rows = scaled(vectors)
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k)


SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vectors q JOIN vectors v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x)
  WHERE q.vec_id % 100 = 0
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 10
"""
