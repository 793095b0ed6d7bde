"""Ordered logic over revisions, proposals, tokens and queues."""

from __future__ import annotations

import sys
from bisect import insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import micros
from ..functions.lineage import cut
from ..functions.running import running

# Executors need not have this package installed: ship its helpers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def policy_timeline(policies: DataFrame, span: int = 1000) -> DataFrame:
    """Revision history as intervals ``[issued_at, min(expires_at, next issued_at))``.

    The next issue time is looked up inside blocks of ``span`` revisions plus the first issue of
    the next non-empty block, so no single task sorts the whole history.
    """
    base = policies.withColumn("_blk", F.floor(F.col("revision") / span))
    firsts = base.groupBy("_blk").agg(F.min_by("issued_at", "revision").alias("_first"))
    following = firsts.select(
        "_blk", F.lead("_first").over(Window.orderBy("_blk")).alias("_next_first")
    )
    inside = F.lead("issued_at").over(Window.partitionBy("_blk").orderBy("revision"))
    return (
        base.join(following, "_blk")
        .withColumn("_next", F.coalesce(inside, F.col("_next_first")))
        .select(
            "revision",
            F.col("issued_at").alias("valid_from"),
            F.least("expires_at", F.coalesce("_next", "expires_at")).alias("valid_to"),
        )
    )


def revision_check(installs: DataFrame, chunk: int = 86400) -> DataFrame:
    """Flag installs that go back to an older revision or change the content of the current one.

    An install is judged against the policy then installed: the last accepted one. A refused
    install never replaces it, so the one installed is the highest revision seen so far, with
    the content it first came with.
    """
    firsts = installs.groupBy("device_id", "revision").agg(
        F.min_by("content_hash", F.struct("ts", "seq")).alias("_first_hash")
    )
    marked = installs.join(firsts, ["device_id", "revision"]).select(
        *installs.columns, "_first_hash"
    )
    tracked = running(
        marked,
        ["device_id"],
        ["ts", "seq"],
        F.floor(micros(installs, "ts") / (chunk * 1_000_000)),
        {"_seen": ("max", F.col("revision"))},
        inclusive=False,
    )
    return tracked.withColumn(
        "outcome",
        F.when(F.col("revision") < F.col("_seen"), "policy_revision_regressed")
        .when(
            (F.col("revision") == F.col("_seen")) & (F.col("content_hash") != F.col("_first_hash")),
            "policy_revision_conflict",
        )
        .otherwise("accepted"),
    ).drop("_first_hash", "_seen")


def _successors(known: DataFrame, chunk: int) -> DataFrame:
    """``expected, at, next``: for each proposal the first later one of the revision after its own.

    Proposals of a revision and those that look for one there are read backwards in time, hour
    by hour, so a revision that a third of all proposals expect is many tasks.
    """
    asked = known.select((F.col("expected") + 1).alias("expected"), "at", F.lit(0).alias("_is"))
    both = known.select("expected", "at", F.lit(1).alias("_is")).unionByName(asked)
    seen = running(
        both,
        ["expected"],
        [F.desc("at"), "_is"],
        -F.floor(F.col("at._t") / (chunk * 1_000_000)),
        {"next": ("min", F.when(F.col("_is") == 1, F.col("at")))},
    )
    return seen.filter(F.col("_is") == 0).select((F.col("expected") - 1).alias("expected"), "at", "next")


def publish_outcome(
    proposals: DataFrame, start: int | None = None, chunk: int = 3600
) -> DataFrame:
    """Of proposals expecting the same revision the first one to arrive while it is current wins.

    ``start`` is the revision in force before the first proposal (default: the lowest expected).
    The winner of a revision is the first proposal that arrives after the winner of the one
    before. So every proposal has one successor, and the winners are the chain from the first
    winner. Links are doubled each round, and the winners found so far follow them: a chain of n
    revisions takes about log2(n) rounds, whatever the history, and no task sees it whole.
    """
    at = F.struct(micros(proposals, "ts").alias("_t"), "id")
    known = proposals.select(F.col("expected_revision").alias("expected"), at.alias("at"))
    lowest = known.agg(F.min("expected").alias("m")) if start is None else None
    base = F.lit(start) if start is not None else lowest.select("m").scalar()
    known = known.filter(F.col("expected") >= base)
    jump = cut(_successors(known, chunk).filter(F.col("next").isNotNull()).select("at", "next"))
    first = known.filter(F.col("expected") == base).agg(F.min("at").alias("at"))
    won = cut(first.filter(F.col("at").isNotNull()))
    while True:
        reached = won.join(jump, "at").select(F.col("next").alias("at"))
        if reached.isEmpty():
            break
        # The links cross from the winners so far to as many more, so no proposal comes twice.
        won = cut(won.unionByName(reached))
        after = jump.select(F.col("at").alias("next"), F.col("next").alias("_then"))
        jump = cut(jump.join(after, "next").select("at", F.col("_then").alias("next")))
    winners = won.select(F.col("at.id").alias("id"), F.lit(True).alias("_won"))
    return proposals.join(winners, "id", "left").select(
        *proposals.columns,
        F.when(F.col("_won"), "published").otherwise("conflict").alias("outcome"),
        F.when(F.col("_won"), F.col("expected_revision") + 1).alias("revision"),
    )


def token_redeem(
    tokens: DataFrame, uses: DataFrame, minutes: int = 15
) -> DataFrame:
    """First use inside the lifetime succeeds; every other use is refused.

    The winner per token is a partial-aggregated minimum, so a token hammered by a third of all
    uses costs one row per task in the shuffle.
    """
    issued = tokens.select("token", "issued_at")
    timed = uses.join(issued, "token", "left").withColumn(
        "_ok",
        (F.col("used_at") >= F.col("issued_at"))
        & (F.col("used_at") < F.col("issued_at") + F.make_interval(mins=F.lit(minutes))),
    )
    first = (
        timed.filter("_ok")
        .groupBy("token")
        .agg(F.min(F.struct("used_at", "use_id")).alias("_first"))
    )
    return (
        timed.join(first, "token", "left")
        .withColumn(
            "accepted", F.coalesce(F.col("use_id") == F.col("_first.use_id"), F.lit(False))
        )
        .select(*uses.columns, "accepted")
    )


def queue_capacity(
    queue: DataFrame, max_n: int = 4096, max_bytes: int = 4 << 20, chunk: int = 1000
) -> DataFrame:
    """Accept while the device queue has room for the row; a later, smaller row may still fit.

    Everything up to a device's first overflow is decided by running sums. After it room only
    shrinks, and rows larger than the room are out for good. Of the rest, rows of at most half
    the room all fit until one of three things happens: their sum passes half the room, a larger
    row fits beside them, or the count is full. The first of these is found by running sums, and
    leaves less than half the room: so a device takes as many rounds as its room has bits at
    most, each over the rows that may still fit, and is many tasks in each.
    """
    at = F.floor(F.col("seq") / chunk)
    sized = running(
        queue, ["device_id"], ["seq"], at, {"_n": ("sum", F.lit(1)), "_b": ("sum", F.col("bytes"))},
    ).withColumn("_over", (F.col("_n") > max_n) | (F.col("_b") > max_bytes))
    heads = sized.groupBy("device_id").agg(
        F.min(F.when(F.col("_over"), F.col("seq"))).alias("_stop"),
    )
    placed = cut(
        sized.join(heads, "device_id")
        .withColumn("_head", F.col("_stop").isNull() | (F.col("seq") < F.col("_stop")))
        .drop("_over", "_stop")
    )
    used = placed.filter("_head").groupBy("device_id").agg(F.max("_n").alias("_n"), F.max("_b").alias("_b"))
    # What a device has left after the head; one whose first row overflows has all of it.
    room = (
        placed.filter(~F.col("_head")).select("device_id").distinct().join(used, "device_id", "left")
        .select(
            "device_id", (F.lit(max_n) - F.coalesce("_n", F.lit(0))).alias("_left"),
            (F.lit(max_bytes) - F.coalesce("_b", F.lit(0))).alias("_room"), F.lit(None).cast("long").alias("_last"),
        )
    )
    rows = placed.filter(~F.col("_head")).select("device_id", "seq", "bytes")
    fitted: DataFrame | None = None
    while True:
        open_ = cut(
            rows.join(room, "device_id").filter(
                (F.col("_left") > 0) & (F.col("bytes") <= F.col("_room"))
                & (F.col("_last").isNull() | (F.col("seq") > F.col("_last")))
            ).drop("_last")
        )
        if open_.isEmpty():
            break
        rows = open_.select("device_id", "seq", "bytes")
        small = F.col("bytes") * 2 <= F.col("_room")
        summed = running(
            open_, ["device_id"], ["seq"], at,
            {"_s": ("sum", F.when(small, F.col("bytes")).otherwise(0)), "_c": ("sum", small.cast("long"))},
        )
        fits = ~small & (F.col("bytes") + F.col("_s") <= F.col("_room")) & (F.col("_c") < F.col("_left"))
        full = small & ((F.col("_s") * 2 > F.col("_room")) | (F.col("_c") >= F.col("_left")))
        events = summed.filter(fits | full).groupBy("device_id").agg(F.min("seq").alias("_last"))
        told = summed.join(events, "device_id", "left").filter(
            (small & (F.col("_last").isNull() | (F.col("seq") <= F.col("_last")))) | (F.col("seq") == F.col("_last"))
        )
        taken = cut(told.select("device_id", "seq", "bytes", "_left", "_room", "_last"))
        more = taken.select("device_id", "seq")
        fitted = more if fitted is None else fitted.unionByName(more)
        # A device without such an event has taken all that fits it.
        room = taken.filter(F.col("_last").isNotNull()).groupBy("device_id").agg(
            (F.max("_left") - F.count(F.lit(1))).alias("_left"), (F.max("_room") - F.sum("bytes")).alias("_room"),
            F.max("_last").alias("_last"),
        )
    out = placed.select(*queue.columns, "_head")
    if fitted is None:
        out = out.withColumn("accepted", F.col("_head"))
    else:
        late = fitted.withColumn("_late", F.lit(True))
        out = out.join(late, ["device_id", "seq"], "left").withColumn(
            "accepted", F.col("_head") | F.coalesce("_late", F.lit(False))
        )
    return out.withColumn("outcome", F.when(F.col("accepted"), "queued").otherwise("outbox_full")).select(
        *queue.columns, "accepted", "outcome"
    )


def batches(
    queue: DataFrame, n: int = 100, keys: Sequence[str] = ("device_id",), chunk: int = 1000
) -> DataFrame:
    """Add ``batch``: which upload of at most ``n`` rows, oldest first, a row belongs to."""
    numbered = running(
        queue, list(keys), ["seq"], F.floor(F.col("seq") / chunk), {"_rn": ("sum", F.lit(1))}
    )
    return numbered.withColumn(
        "batch", F.floor((F.col("_rn") - 1) / n).cast("long")
    ).drop("_rn")


def first_duplicate_wins(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """Keep the earliest row of each identical key tuple.

    ``min_by`` keeps one row per task and key before the shuffle; a window would move and sort
    every copy of a hot tuple.
    """
    cols = df.columns
    by = F.col(order) if isinstance(order, str) else order
    # Grouping by a digest keeps long key texts from being shuffled twice. Struct fields that
    # are NULL are left out of JSON, so NULL and any string stay apart.
    digest = F.sha2(F.to_json(F.struct(*keys)), 256)
    return (
        df.withColumn("_order", by)
        .groupBy(digest.alias("_key"))
        .agg(F.min_by(F.struct(*cols), "_order").alias("_row"))
        .select("_row.*")
    )


def best_checkpoint(log: DataFrame) -> DataFrame:
    """Per model the step with the best development accuracy (earliest on ties) and the latest."""
    return log.groupBy("model").agg(
        F.max_by("step", F.struct("accuracy", -F.col("step"))).alias("best_step"),
        F.max("accuracy").alias("best_accuracy"),
        F.max("step").alias("latest_step"),
        F.max_by("accuracy", "step").alias("latest_accuracy"),
    )


#: Windows of time in one chunk of an account: states mostly meet again within a chunk.
CHUNK_WINDOWS = 64


def _admitted(times: np.ndarray, state: list[int], limit: int, window: int) -> np.ndarray:
    """Which attempts, in order of time, are admitted. ``state`` (the latest admitted, at most
    ``limit``, ascending) is brought up to date. Refused stretches are jumped over."""
    out = np.zeros(len(times), bool)
    at = 0
    while at < len(times) and limit > 0:
        t = int(times[at])
        if len(state) >= limit and t - state[0] < window:
            at += int(np.searchsorted(times[at:], state[0] + window))
            continue
        out[at] = True
        insort(state, t)
        if len(state) > limit:
            del state[0]
        at += 1
    return out


def _flag_fold(limit: int, window: int, names: list[str]):
    """Over chunks of an account, each led by a row with its entry state: which attempts are admitted."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[int] = []
        for batch in batches:
            lead = batch.column("_kind").to_numpy() == 0
            times = batch.column("_t").to_numpy()
            flags = np.zeros(batch.num_rows, bool)
            start = 0
            for end in [*np.flatnonzero(lead).tolist(), batch.num_rows]:
                if end > start:
                    flags[start:end] = _admitted(times[start:end], state, limit, window)
                if end < batch.num_rows:
                    state = sorted(batch.column("_entry")[end].as_py())
                start = end + 1
            out = [batch.column("account"), batch.column("attempt_id"), pa.array(flags)]
            yield pa.RecordBatch.from_arrays(out, names=names).filter(pa.array(~lead))

    return fold


def _exit_fold(limit: int, window: int, size: int):
    """Over runs of chunks, each run led by a row with its entry state: every chunk's entry and exit."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[int] = []
        entry: list[int] = []
        account = chunk = kind = None
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            lists = pa.list_(pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.int64(), lists, lists))]
            return pa.RecordBatch.from_arrays(columns, names=["account", "_chunk", "_entry", "_exit"])

        for batch in batches:
            kind = batch.schema.field("account").type
            lead = batch.column("_kind").to_numpy() == 0
            chunks, times = batch.column("_chunk").to_numpy(), batch.column("_t").to_numpy()
            new = lead.copy()
            new[1:] |= chunks[1:] != chunks[:-1]
            new[:1] = True
            starts = np.flatnonzero(new)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                if lead[a] or chunks[a] != chunk:
                    if chunk is not None:
                        out.append((account, chunk, entry, list(state)))
                    chunk = int(chunks[a])
                    if lead[a]:
                        account = batch.column("account")[a].as_py()
                        state = sorted(batch.column("_entry")[a].as_py())
                    else:
                        state = [x for x in state if x > chunk * size - window]
                    entry = list(state)
                a += bool(lead[a])
                _admitted(times[a:b], state, limit, window)
            if len(out) >= 10_000:
                yield told()
                out.clear()
        if chunk is not None:
            out.append((account, chunk, entry, list(state)))
        if out:
            yield told()

    return fold


def throttle(
    attempts: DataFrame, limit: int, seconds: int, before: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Which attempts are admitted, and each account's latest admitted times (microseconds).

    The rule is sequential, so it is run speculatively: an account's time is cut into chunks of
    ``CHUNK_WINDOWS`` windows, every chunk is folded from a guessed entry state, and those whose
    entry turns out otherwise (it is the exit of the chunk before) are folded again, until none
    is. Mostly states meet again within a chunk, and few chunks are folded twice. Where they do
    not, as in a steady flood, a round goes on over twice as many chunks as the one before: so
    rounds are at most the logarithm of an account's chunks. Rows stream through a fold; its
    state is at most ``limit`` numbers. Flags are told by chunk, many tasks for a busy account.

    ``before`` (``account, admitted``) holds what earlier calls admitted.
    """
    window = seconds * 1_000_000
    size = max(1, window) * CHUNK_WINDOWS
    times = "array<long>"
    parts = int(attempts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(
        attempts.select(
            "account", "attempt_id", F.floor(micros(attempts, "ts") / size).cast("long").alias("_chunk"),
            micros(attempts, "ts").cast("long").alias("_t"), F.lit(1).alias("_kind"),
            F.array().cast(times).alias("_entry"),
        )
    )
    key = ["account", "_chunk"]

    def led(todo: DataFrame, entries: DataFrame, by: Column) -> DataFrame:
        leads = entries.select(
            "account", F.lit(None).cast(rows.schema["attempt_id"].dataType).alias("attempt_id"), "_chunk",
            F.lit(0).cast("long").alias("_t"), F.lit(0).alias("_kind"), "_entry",
        )
        order = ["account", "_run", "_chunk", "_kind", "_t", "attempt_id"]
        return todo.unionByName(leads).withColumn("_run", by).repartition(parts, "account", "_run").sortWithinPartitions(*order)

    def folded(todo: DataFrame, entries: DataFrame, by: Column) -> DataFrame:
        lists = T.ArrayType(T.LongType())
        schema = T.StructType([rows.schema["account"], rows.schema["_chunk"]]).add("_entry", lists).add("_exit", lists)
        return led(todo, entries, by).mapInArrow(_exit_fold(limit, window, size), schema)

    entry = rows.select(*key).distinct()
    first = entry.groupBy("account").agg(F.min("_chunk").alias("_chunk"))
    if before is None:
        first = first.withColumn("_first", F.lit(None).cast(times))
    else:
        first = first.join(before.select("account", F.col("admitted").alias("_first")), "account", "left")
    entry = entry.join(first, key, "left").select(*key, F.coalesce("_first", F.array().cast(times)).alias("_entry"))
    known = cut(folded(rows, entry, F.col("_chunk")))
    turn = 0
    while True:
        prior = known.select("account", (F.col("_chunk") + 1).alias("_chunk"), F.col("_exit").alias("_prior"))
        # A chunk is longer than a window, so only the chunk just before it counts.
        recent = F.filter("_prior", lambda a: a > F.col("_chunk") * size - window)
        wanted = known.join(prior, key, "left").withColumn("_next", F.coalesce(recent, F.col("_entry")))
        changed = wanted.filter(F.col("_next") != F.col("_entry"))
        run = F.shiftright("_chunk", turn)
        starts = cut(
            changed.groupBy("account", run.alias("_run")).agg(F.min(F.struct("_chunk", "_next")).alias("_start"))
            .select("account", "_run", F.col("_start._chunk").alias("_from"), F.col("_start._next").alias("_next"))
        )
        if starts.isEmpty():
            break
        todo = rows.withColumn("_run", run).join(starts.select("account", "_run", "_from"), ["account", "_run"])
        entries = starts.select("account", F.col("_from").alias("_chunk"), F.col("_next").alias("_entry"))
        again = cut(folded(todo.filter(F.col("_chunk") >= F.col("_from")).select(*rows.columns), entries, run))
        known = cut(known.join(again.select(*key), key, "left_anti").unionByName(again))
        turn += 1
    told = T.StructType(
        [rows.schema["account"], rows.schema["attempt_id"], T.StructField("admitted", T.BooleanType())]
    )
    flags = led(rows, known.select(*key, "_entry"), F.col("_chunk")).mapInArrow(_flag_fold(limit, window, told.names), told)
    return flags, known.groupBy("account").agg(F.max_by("_exit", "_chunk").alias("admitted"))


def attempt_throttle(attempts: DataFrame, limit: int = 20, seconds: int = 60) -> DataFrame:
    """Admit an attempt only if fewer than ``limit`` were admitted in the last ``seconds``.

    Refused attempts do not count. Attempts of one time are taken by ``attempt_id``.
    """
    return throttle(attempts, limit, seconds)[0]


def throttle_estimate(
    attempts: DataFrame, limit: int = 20, seconds: int = 60, chunk: int = 900
) -> DataFrame:
    """Native flag that counts refused attempts too: an upper bound on what would be refused.

    Time is cut into chunks of at least ``chunk`` seconds; the last window of a chunk is copied
    into the next one, so a busy account is as many tasks as it has chunks.
    """
    window, size = seconds * 1_000_000, max(seconds, chunk) * 1_000_000
    at = F.floor(F.col("_t") / size)
    cells = F.array(
        F.struct(at.alias("chunk"), F.lit(True).alias("own")),
        F.when(F.col("_t") > (at + 1) * size - window, F.struct((at + 1).alias("chunk"), F.lit(False).alias("own"))),
    )
    dealt = attempts.withColumn("_t", micros(attempts, "ts")).withColumn("_cell", F.explode(F.array_compact(cells)))
    w = Window.partitionBy("account", "_cell.chunk").orderBy("_t").rangeBetween(-window + 1, 0)
    return (
        dealt.withColumn("over_limit", F.count(F.lit(1)).over(w) > limit)
        .filter("_cell.own")
        .drop("_t", "_cell")
    )
