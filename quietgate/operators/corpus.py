"""Labelled corpus building: template expansion, perturbation, splits, checks and manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import stored
from ..functions.running import running
from ..functions.scores import LABELS
from .aggregates import row_digest, split_manifest
from .joins import corpus_leak, split_overlap
from .sorts import deterministic_shuffle
from .windows import first_duplicate_wins

LANGUAGES = ["ko", "en"]
# Repetitions per split.
REPETITIONS = {"train": 12, "dev": 4, "calibration": 5, "test": 6}
# Policy asked of a match row to make its counterfactual negative.
CROSS = {
    "customer_records": "proprietary_technical",
    "commercial_terms": "hr_records",
    "hr_records": "commercial_terms",
    "proprietary_technical": "customer_records",
    "strategic_finance": "customer_records",
    "personal_sensitive": "commercial_terms",
}
# Wrappers around a generated text, per language.
WRAPPERS = {
    "ko": ["{}", "업무 메모\n{}\n끝.", "검토 대상 발췌:\n{}", "자료 본문\n---\n{}\n---"],
    "en": ["{}", "Work note\n{}\nEnd.", "Excerpt for inspection:\n{}", "Document body\n---\n{}\n---"],
}
WRAPPER_KEYS = {"ko": "제출내용", "en": "submitted_content"}
# Neutral lead-in, per language.
DISTRACTORS = {
    "ko": "공통 안내: 자료의 항목과 문맥을 함께 확인하세요.\n",
    "en": "General note: review the fields together with their context.\n",
}
# Numeric placeholders as (lowest, highest).
NUMBERS = {"qty": (2, 37), "small": (2, 90), "rate": (3, 39), "day": (1, 28)}
PORTS = [8443, 9443, 10443, 18081]


def required(value: Column, kind: str, what: str, *keys: str) -> Column:
    """The value, or an error that names the keys: a row is never dropped for want of a match."""
    told = F.concat(F.lit(what + ": "), F.concat_ws(" ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys]))
    return F.coalesce(value, F.raise_error(told).cast(kind))


def pick(salt: str, n: Column | int, *keys: str) -> Column:
    """Deterministic number in ``[0, n)`` from the row's keys, the same on any engine."""
    size = F.lit(n) if isinstance(n, int) else n
    text = F.concat_ws("|", F.lit(salt), *[F.col(k).cast("string") for k in keys])
    return F.pmod(
        F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), size
    ).cast("int")


ROW = ("source_family", "language", "i")


def expand_templates(
    seeds: DataFrame, pools: DataFrame, reps: Mapping[str, int] = REPETITIONS
) -> DataFrame:
    """Seeds x languages x repetitions, with every placeholder filled.

    ``seeds(family, domain, split, gold, ko, en)``; ``pools(split, language, field, choices)``,
    where an empty split means any. Expansion is an explode of a small sequence per seed, and
    each pool is looked up by an equi join. A seed of an unknown split is an error.
    """
    counts = F.create_map(*[F.lit(x) for kv in reps.items() for x in kv])
    times = required(F.try_element_at(counts, F.coalesce("split", F.lit(""))), "int", "unknown split", "split", "family")
    rows = (
        seeds.withColumn("language", F.explode(F.array(*[F.lit(x) for x in LANGUAGES])))
        .withColumn("i", F.explode(F.sequence(F.lit(0), times - 1)))
        .select(
            F.col("family").alias("source_family"),
            "domain",
            "split",
            "gold",
            "language",
            "i",
            F.when(F.col("language") == "ko", F.col("ko")).otherwise(F.col("en")).alias("text"),
        )
    )
    filled = rows.join(_pool_maps(pools), ["split", "language"], "left")
    text = F.col("text")
    for field in ("person", "org", "product", "condition"):
        choices = F.col("_pool")[field]
        text = F.replace(
            text,
            F.lit("{" + field + "}"),
            F.coalesce(
                F.get(choices, pick(field, F.greatest(F.size(choices), F.lit(1)), *ROW)), F.lit("")
            ),
        )
    number = {f: pick(f, hi - lo + 1, *ROW) + lo for f, (lo, hi) in NUMBERS.items()}
    number["money"] = number["small"] + pick("money", 851, *ROW) + 100
    number["port"] = F.get(F.array(*[F.lit(p) for p in PORTS]), pick("port", len(PORTS), *ROW))
    for field, value in number.items():
        text = F.replace(text, F.lit("{" + field + "}"), value.cast("string"))
    return filled.withColumn("text", text).drop("_pool")


def _pool_maps(pools: DataFrame) -> DataFrame:
    """One row per split and language: field -> choices (a handful of fields each)."""
    wide = pools.withColumn("split", F.explode(
        F.when(F.col("split") == "", F.array(*[F.lit(s) for s in REPETITIONS])).otherwise(
            F.array("split")
        )
    ))
    return wide.groupBy("split", "language").agg(
        F.map_from_entries(F.collect_set(F.struct("field", "choices"))).alias("_pool")
    )


def perturb(rows: DataFrame, attacks: DataFrame | None = None) -> DataFrame:
    """Add an embedded instruction, a neutral lead-in and a wrapper to set shares of the rows.

    Every label gets the same treatment, so none of it is a shortcut to the label. ``attacks``
    has the shape of ``pools`` with field ``attack``.
    """
    none = F.array().cast("array<string>")
    if attacks is None:
        work = rows.withColumn("_attack", F.lit(None).cast("string"))
    else:
        listed = _pool_maps(attacks)
        spoken = rows.withColumn(
            "_lang", F.when(F.col("i") % 3 == 1, "en").otherwise(F.col("language"))
        )
        choices = F.col("_pool")["attack"]
        work = (
            spoken.join(listed.withColumnRenamed("language", "_lang"), ["split", "_lang"], "left")
            .withColumn(
                "_attack", F.get(choices, pick("attack", F.greatest(F.size(choices), F.lit(1)), *ROW))
            )
            .drop("_pool", "_lang")
        )
    attacked = (F.col("i") % 4 == 1) & F.col("_attack").isNotNull()
    led = F.col("i") % 6 == 5
    ko = F.col("language") == "ko"
    lead = F.repeat(
        F.when(ko, DISTRACTORS["ko"]).otherwise(DISTRACTORS["en"]), pick("lead", 5, *ROW) + 3
    )
    body = F.when(attacked, F.concat("text", F.lit("\n\n"), F.col("_attack"))).otherwise(
        F.col("text")
    )
    body = F.when(led, F.concat(lead, body)).otherwise(body)

    def wrapped(language: str) -> Column:
        options = WRAPPERS[language]
        which = pick("wrap", len(options) + 1, *ROW)
        out = F.concat(
            F.lit('{"' + WRAPPER_KEYS[language] + '": '),
            F.regexp_extract(F.to_json(F.struct(F.col("_body").alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1),
            F.lit("}"),
        )
        for n, option in enumerate(options):
            head, tail = option.split("{}")
            out = F.when(
                which == n, F.concat(F.lit(head), F.col("_body"), F.lit(tail))
            ).otherwise(out)
        return out

    return (
        work.withColumn("_body", body)
        .withColumn(
            "tags",
            F.concat(
                F.when(attacked, F.array(F.lit("embedded_instruction"))).otherwise(none),
                F.when(led, F.array(F.lit("distractor_prefix"))).otherwise(none),
            ),
        )
        .withColumn("text", F.when(ko, wrapped("ko")).otherwise(wrapped("en")))
        .drop("_body", "_attack")
    )


def counterfactual(rows: DataFrame, cross: Mapping[str, str] = CROSS) -> DataFrame:
    """Rows plus every third match row asked under a disjoint policy, where it is no match.

    A domain without a disjoint policy is an error.
    """
    other = F.create_map(*[F.lit(x) for kv in cross.items() for x in kv])
    own = rows.withColumn("policy_id", F.col("domain")).withColumn("_cross", F.lit(False))
    crossed = (
        rows.filter((F.col("gold") == "match") & (F.col("i") % 3 == 0))
        .withColumn(
            "policy_id",
            required(F.try_element_at(other, F.coalesce("domain", F.lit(""))), "string", "no cross policy", "domain"),
        )
        .withColumn("gold", F.lit("no_match"))
        .withColumn("tags", F.array_append("tags", "counterfactual_policy"))
        .withColumn("_cross", F.lit(True))
    )
    return own.unionByName(crossed)


def ask(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Attach the policy's question and choices, alternating its language.

    ``questions(policy_id, policy_language, question, prefixes, choices)``; a row whose policy
    has no question in its language is an error. Questions are stored first: as few as they are,
    their size lets the join leave the texts where they lie, whatever the questions derive from.
    """
    spoken = rows.withColumn(
        "policy_language",
        F.when((F.col("i") + (F.col("language") == "en").cast("int")) % 2 == 0, "ko").otherwise("en"),
    )
    prefix = F.get(
        "prefixes", pick("prefix", F.greatest(F.size("prefixes"), F.lit(1)), *ROW, "policy_id")
    )
    return (
        spoken.join(stored(questions), ["policy_id", "policy_language"], "left")
        .withColumn(
            "question",
            F.concat(
                F.coalesce(prefix, F.lit("")),
                required(F.col("question"), "string", "no question", "policy_id", "policy_language"),
            ),
        )
        .drop("prefixes")
    )


def build_corpus(
    seeds: DataFrame,
    pools: DataFrame,
    benchmark: DataFrame,
    questions: DataFrame,
    attacks: DataFrame | None = None,
    seed: int = 20261003,
) -> dict[str, DataFrame]:
    """The corpus with its manifest and its violations (empty frames mean a clean build).

    ``index`` names the corpus's rows without their texts: ``id, split, source_family, document_id``;
    ``leaked`` is those of its rows whose text is in the benchmark.
    """
    rows = ask(counterfactual(perturb(expand_templates(seeds, pools), attacks)), questions)
    number = F.lpad(F.col("i").cast("string"), 2, "0")
    named = rows.select(
        F.concat_ws(
            "-",
            "source_family",
            "language",
            F.concat(number, F.when(F.col("_cross"), "-cross").otherwise("")),
        ).alias("id"),
        "split",
        "source_family",
        F.sha2("text", 256).alias("document_id"),
        "policy_id",
        "language",
        "policy_language",
        "text",
        "question",
        "choices",
        "gold",
        "tags",
    )
    full = named.withColumn("_choices", F.to_json("choices"))
    key = ["split", "document_id", "question", "gold", "_choices"]
    # Rows that repeat in the key are one row of the corpus. What the manifest and the checks read
    # of a row is its digest and its names, so no text is shuffled; hashes travel as bytes, half
    # as long as their digits.
    told = F.struct(
        "id",
        "split",
        "source_family",
        F.unhex("document_id").alias("document_id"),
        F.unhex(row_digest(named.columns)).alias("_digest"),
    )
    unique = stored(
        full.groupBy(F.unhex(F.sha2(F.to_json(F.struct(*key)), 256)).alias("_key"))
        .agg(F.min(told).alias("_row"), F.count(F.lit(1)).alias("_copies"))
        .select("_row.*", "_copies")
    )
    spelled = {"document_id": F.lower(F.hex("document_id"))}
    index = unique.drop("_copies", "_digest").withColumns(spelled)
    removed = unique.groupBy("split").agg(F.sum(F.col("_copies") - 1).alias("rows"))
    return {
        "corpus": deterministic_shuffle(first_duplicate_wins(full, key, "id").drop("_choices"), "id", seed),
        "index": index,
        "manifest": split_manifest(unique, removed, F.lower(F.hex("_digest"))),
        "crossing": split_overlap(unique, "document_id").withColumns(spelled),
        "leaked": corpus_leak(index, benchmark, digest="document_id"),
    }


def family_split(
    df: DataFrame, family: str, weights: Mapping[str, int] | None = None
) -> DataFrame:
    """Add ``split``: whole families by a hash of their name, so no family crosses a split.

    Row-local: the hash alone decides, with nothing to shuffle. MD5 gives the same split on any
    engine.
    """
    shares = dict(weights or {"train": 70, "dev": 10, "calibration": 10, "test": 10})
    total = sum(shares.values())
    bucket = F.pmod(
        F.conv(F.substring(F.md5(F.col(family).cast("string")), 1, 8), 16, 10).cast("long"),
        F.lit(total),
    )
    out, upto = F.lit(None).cast("string"), total
    for name, share in reversed(list(shares.items())):
        out = F.when(bucket < upto, F.lit(name)).otherwise(out)
        upto -= share
    return df.withColumn("split", out)


def corpus_checks(
    corpus: DataFrame, languages: Sequence[str] = tuple(LANGUAGES), manifest: DataFrame | None = None
) -> DataFrame:
    """Violations, empty when the corpus is sound: ``(check, subject, detail)``."""
    spec = lambda name, df, subject, detail: df.select(
        F.lit(name).alias("check"),
        subject.cast("string").alias("subject"),
        detail.cast("string").alias("detail"),
    )
    labels = (
        corpus.groupBy("split", "policy_id", "language")
        .agg(*[F.count_if(F.col("gold") == x).alias(x) for x in LABELS])
        .filter(" or ".join(f"{x} = 0" for x in LABELS))
    )
    spoken = corpus.groupBy("split").agg(
        *[F.count_if(F.col("language") == x).alias(f"l_{x}") for x in languages],
        *[F.count_if(F.col("policy_language") == x).alias(f"p_{x}") for x in languages],
    )
    mute = spoken.filter(
        " or ".join(f"l_{x} = 0 or p_{x} = 0" for x in languages)
    )
    repeated = (
        corpus.groupBy("split", F.sha2(F.to_json(F.struct("text", "question", "choices", "gold")), 256).alias("k"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    out = (
        spec(
            "label_missing",
            labels,
            F.concat_ws("/", "split", "policy_id", "language"),
            F.concat_ws("/", *LABELS),
        )
        .unionByName(spec("language_missing", mute, F.col("split"), F.lit("")))
        .unionByName(spec("duplicate_decision", repeated, F.col("k"), F.col("n")))
        .unionByName(
            spec("family_crosses_split", split_overlap(corpus, "source_family"),
                 F.col("source_family"), F.col("rows"))
        )
        .unionByName(
            spec("document_crosses_split", split_overlap(corpus, "document_id"),
                 F.col("document_id"), F.col("rows"))
        )
    )
    if manifest is not None:
        fresh = split_manifest(corpus).select("split", F.col("content_hash").alias("_h"))
        changed = manifest.join(fresh, "split", "full_outer").filter(
            ~F.col("content_hash").eqNullSafe(F.col("_h"))
        )
        out = out.unionByName(spec("manifest_mismatch", changed, F.col("split"), F.col("_h")))
    return out


def strip_text(df: DataFrame, *texts: str) -> DataFrame:
    """Drop protected text columns before publishing."""
    return df.drop(*(texts or ("text",)))


def stratified_probe(corpus: DataFrame) -> DataFrame:
    """First row of each policy and gold label, the language alternating by policy.

    The row per stratum is a partial-aggregated ``min_by``.
    """
    cols = corpus.columns
    first = corpus.groupBy("policy_id", "gold", "language").agg(
        F.min_by(F.struct(*cols), "id").alias("_row")
    )
    policies = running(
        corpus.select("policy_id").distinct(), [], ["policy_id"],
        F.substring("policy_id", 1, 1), {"_rank": ("sum", F.lit(1))},
    )
    wanted = F.when(F.col("_rank") % 2 == 0, "ko").otherwise("en")
    return first.join(policies, "policy_id").filter(F.col("language") == wanted).select("_row.*")
