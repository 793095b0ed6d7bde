"""Joins between events, devices, policies, queues and predictions.

No side is hinted: the optimizer broadcasts by measured size, and adaptive execution splits a
skewed side. Keys that are few by nature (hours) are salted.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need not have this package installed: ship its helpers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Largest time block of the interval index: 2**20 seconds, above the 7-day policy lifetime.
_TOP = 20
# Fixed value: a policy expires after its issue, and at most so many seconds after it.
LIFETIME = 7 * 24 * 3600
# A busy hour is dealt over so many tasks; the segments of an hour are few and go to each.
HOUR_PARTS = 16


def events_with_device(events: DataFrame, devices: DataFrame, n: int = 200) -> DataFrame:
    """Newest ``n`` events of known devices, with the device name."""
    names = devices.select(
        F.col("id").alias("device_id"), F.col("name").alias("device_name")
    )
    return (
        events.join(names, "device_id")
        .orderBy(F.desc("received_at"), F.desc("event_id"))
        .limit(n)
    )


def policy_maps(policy_rules: DataFrame) -> DataFrame:
    """Exploded ``(revision, rule, action)`` rows folded back to one map per revision."""
    return policy_rules.groupBy("revision").agg(
        F.map_from_entries(F.collect_set(F.struct("rule", "action"))).alias("policy_rules")
    )


def blocks(rules: Column, actions: Column) -> Column:
    """True when any rule is set to something other than monitor; an absent rule blocks."""
    return F.exists(
        rules, lambda r: F.coalesce(F.try_element_at(actions, r), F.lit("block")) != "monitor"
    )


def rule_actions(events: DataFrame, policy_rules: DataFrame) -> DataFrame:
    """Add ``blocked`` per event from the rule map of its revision.

    The map (at most one entry per rule) is joined, so events are never exploded or regrouped.
    """
    maps = policy_maps(policy_rules).withColumnRenamed("revision", "policy_revision")
    none = F.create_map().cast("map<string,string>")
    return (
        events.join(maps, "policy_revision", "left")
        .withColumn("blocked", blocks(F.col("rules"), F.coalesce("policy_rules", none)))
        .drop("policy_rules")
    )


def _cover(lo: str, hi: str) -> Column:
    """Canonical power-of-two blocks covering ``[lo, hi)``: at most two per level below the top.

    Below the top level a block is used when its parent does not fit: an odd first block and an
    odd end. What remains in between is covered one level up.
    """
    return F.expr(
        f"""
        flatten(transform(sequence(0, {_TOP}), k -> transform(
          filter(
            CASE WHEN k = {_TOP} AND ceil({lo} / power(2, k)) < floor({hi} / power(2, k))
                   THEN sequence(ceil({lo} / power(2, k)), floor({hi} / power(2, k)) - 1)
                 WHEN k < {_TOP} AND ceil({lo} / power(2, k)) < floor({hi} / power(2, k))
                   THEN array_distinct(array(
                     CASE WHEN ceil({lo} / power(2, k)) % 2 = 1 THEN ceil({lo} / power(2, k)) END,
                     CASE WHEN floor({hi} / power(2, k)) % 2 = 1 THEN floor({hi} / power(2, k)) - 1 END))
                 ELSE array() END,
            b -> b IS NOT NULL),
          b -> named_struct('level', k, 'block', cast(b as bigint)))))
        """
    )


def valid_period() -> Column:
    return F.col("expires_at").between(F.col("issued_at") + 1, F.col("issued_at") + LIFETIME)


def policy_segments(policies: DataFrame, bucket: int = 3600) -> DataFrame:
    """Disjoint ``(bucket, lo, hi, revision)`` pieces of time with the policy in force.

    A revision is usable from 60 s before its issue until it expires; the highest usable one is
    in force. One that does not expire after its issue, or more than ``LIFETIME`` after it, is
    never in force, so a policy has a bounded number of hours. Each boundary looks its revision up through an interval index (blocks keyed by
    level, reduced to the highest revision), so no policy is ever paired with every boundary.
    """
    usable = policies.filter(valid_period()).select(
        "revision", (F.col("issued_at") - 60).alias("lo"), F.col("expires_at").alias("hi")
    )
    index = (
        usable.select("revision", F.explode(_cover("lo", "hi")).alias("b"))
        .groupBy("b.level", "b.block")
        .agg(F.max("revision").alias("revision"))
    )
    edges = usable.select(F.explode(F.array("lo", "hi")).alias("at"))
    ticks = usable.select(
        F.explode(
            F.sequence(
                (F.floor(F.col("lo") / bucket) * bucket).cast("long"), F.col("hi"), F.lit(bucket)
            )
        ).alias("at")
    )
    points = edges.union(ticks).distinct()
    levels = F.sequence(F.lit(0), F.lit(_TOP))
    lookups = points.select("at", F.explode(levels).alias("level")).withColumn(
        "block", F.floor(F.col("at") / F.pow(F.lit(2), F.col("level"))).cast("long")
    )
    held = (
        lookups.join(index, ["level", "block"]).groupBy("at").agg(F.max("revision").alias("revision"))
    )
    tagged = points.join(held, "at", "left").withColumn(
        "bucket", F.floor(F.col("at") / bucket).cast("long")
    )
    ahead = Window.partitionBy("bucket").orderBy("at")
    return (
        tagged.withColumn(
            "hi", F.coalesce(F.lead("at").over(ahead), (F.col("bucket") + 1) * bucket)
        )
        .filter(F.col("revision").isNotNull())
        .select("bucket", F.col("at").alias("lo"), "hi", "revision")
    )


def _salt(events: DataFrame) -> Column:
    """A number below ``HOUR_PARTS`` from the values of a row, the same whenever it is computed."""
    plain = [f.name for f in events.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.pmod(F.xxhash64(*plain), F.lit(HOUR_PARTS)).cast("int")


def policy_asof(events: DataFrame, policies: DataFrame, bucket: int = 3600) -> DataFrame:
    """Add the policy in force at each event's ``ts_s``: ``in_force`` (0 when none) and ``in_force_rules``.

    Events may be a stream: rows are salted by their own values, and the policies' side is a
    plain table, read again for every micro-batch.
    """
    segments = policy_segments(policies, bucket).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(HOUR_PARTS - 1)))
    )
    keyed = events.withColumns(
        {"bucket": F.floor(F.col("ts_s") / bucket).cast("long"), "part": _salt(events)}
    )
    e, s = keyed.alias("e"), segments.alias("s")
    held = e.join(
        s,
        (F.col("e.bucket") == F.col("s.bucket"))
        & (F.col("e.part") == F.col("s.part"))
        & (F.col("e.ts_s") >= F.col("s.lo"))
        & (F.col("e.ts_s") < F.col("s.hi")),
        "left",
    ).select(*[F.col(f"e.{c}") for c in events.columns], F.coalesce("s.revision", F.lit(0)).alias("in_force"))
    rules = policies.select(F.col("revision").alias("in_force"), F.col("rules").alias("in_force_rules"))
    return held.join(rules, "in_force", "left").select(*events.columns, "in_force", "in_force_rules")


def applicable_policies(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Enabled policies naming both the request's scenario and its destination."""
    named = (
        policies.filter("enabled")
        .withColumn("scenario_id", F.explode(F.array_distinct("scenarios")))
        .withColumn("destination", F.explode(F.array_distinct("destinations")))
        .drop("scenarios", "destinations", "enabled")
        .withColumnRenamed("id", "policy_id")
    )
    return requests.join(named, ["scenario_id", "destination"])


def unknown_revisions(events: DataFrame, policies: DataFrame) -> DataFrame:
    """Distinct referenced revisions with no policy; 0 means none was in force."""
    return (
        events.filter(F.col("policy_revision") > 0)
        .select("policy_revision")
        .distinct()
        .join(
            policies.select(F.col("revision").alias("policy_revision")),
            "policy_revision",
            "left_anti",
        )
    )


def revoked_filter(reports: DataFrame, devices: DataFrame) -> DataFrame:
    """Reports from devices that are missing or revoked."""
    live = devices.filter(F.col("revoked_at").isNull()).select(F.col("id").alias("device_id"))
    return reports.join(live, "device_id", "left_anti")


def ack_anti(queue: DataFrame, acks: DataFrame) -> DataFrame:
    """Queued events that their own device has no acknowledgement of yet."""
    return queue.join(acks.select("device_id", "event_id"), ["device_id", "event_id"], "left_anti")


def foreign_acks(queue: DataFrame, acks: DataFrame) -> DataFrame:
    """Acknowledgements of ids that the device never queued; must be empty."""
    sent = queue.select("device_id", "event_id")
    return acks.select("device_id", "event_id").join(sent, ["device_id", "event_id"], "left_anti")


def corpus_leak(
    corpus: DataFrame, benchmark: DataFrame, text: str = "text", digest: str | None = None
) -> DataFrame:
    """Corpus rows whose text also occurs in the frozen benchmark, matched by content hash.

    ``digest`` is a column that holds the texts' SHA-256 already.
    """
    frozen = benchmark.select(F.sha2(F.col(text), 256).alias("_content")).distinct()
    return (
        corpus.withColumn("_content", F.col(digest) if digest else F.sha2(F.col(text), 256))
        .join(frozen, "_content", "left_semi")
        .drop("_content")
    )


#: Characters of passages that one automaton holds, on average.
PASSAGE_CHARS = 1 << 20


def passage_leak(
    corpus: DataFrame, benchmark: DataFrame, key: str, text: str = "text", least: int = 1
) -> DataFrame:
    """Corpus rows (``key``) that hold a whole benchmark passage of at least ``least`` characters.

    Passages are dealt into blocks of ``PASSAGE_CHARS`` characters; each block is an automaton of
    all its passages, broadcast, and every text runs through it once, whole and where it lies.
    Only keys of hits leave a task. A null text holds nothing, a null passage is none.
    """
    passages = benchmark.select(F.col(text).alias("_p")).filter(F.length("_p") >= max(1, least)).distinct()
    total = passages.agg(F.coalesce(F.sum(F.length("_p").cast("long")), F.lit(0))).first()[0]
    blocks = -(-total // PASSAGE_CHARS)
    rows = corpus.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = rows.select("_key").limit(0)
    dealt = passages.withColumn("_block", F.pmod(F.xxhash64("_p"), F.lit(max(1, blocks))))
    for block in range(blocks):
        held = [r["_p"] for r in dealt.filter(F.col("_block") == block).select("_p").collect()]
        if held:
            scan = _holders(corpus.sparkSession.sparkContext.broadcast(held))
            found = found.unionByName(rows.mapInArrow(scan, found.schema))
    return found.distinct().select(F.col("_key").alias(key))


def _holders(passages: Broadcast):
    """Keys of the texts that hold one of the passages."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for passage in passages.value:
            automaton.add_word(passage)
        automaton.make_automaton()
        for batch in batches:
            hit = [t.is_valid and next(automaton.iter(t.as_py()), None) is not None for t in batch.column("_text")]
            yield batch.select(["_key"]).filter(pa.array(hit, pa.bool_()))

    return scan


def id_coverage(preds: DataFrame, expected: DataFrame, key: str = "id") -> DataFrame:
    """One row: counts on both sides, ids missing, ids not expected, ids predicted twice."""
    a = preds.groupBy(key).agg(F.count(F.lit(1)).alias("_p"))
    b = expected.groupBy(key).agg(F.count(F.lit(1)).alias("_e"))
    return (
        a.join(b, key, "full_outer")
        .agg(
            F.coalesce(F.sum("_p"), F.lit(0)).alias("predicted"),
            F.coalesce(F.sum("_e"), F.lit(0)).alias("expected"),
            F.count_if(F.col("_p").isNull()).alias("missing"),
            F.count_if(F.col("_e").isNull()).alias("unexpected"),
            F.count_if(F.col("_p") > 1).alias("repeated"),
        )
        .withColumn(
            "covered",
            (F.col("missing") + F.col("unexpected") + F.col("repeated") == 0)
            & (F.col("predicted") == F.col("expected")),
        )
    )


def paired_predictions(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Same id under two models, with the gold label of the second."""
    return a.select(key, F.col("prediction").alias("base_prediction")).join(
        b.select(key, "gold", F.col("prediction").alias("cand_prediction")), key
    )


def split_overlap(corpus: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that occur in more than one split; min/max needs no distinct set per key."""
    keys = [key] if isinstance(key, str) else list(key)
    return (
        corpus.groupBy(*keys)
        .agg(
            F.min("split").alias("first_split"),
            F.max("split").alias("last_split"),
            F.count(F.lit(1)).alias("rows"),
        )
        .filter(F.col("first_split") != F.col("last_split"))
    )
