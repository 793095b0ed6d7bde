"""Readers. Schemas are always given; nothing is inferred."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import stored

# Executors need not have this package installed: ship its helpers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BYTES = 4 * 1024 * 1024
MAX_CHARS = 60000
MAX_ROWS = 10000
MAX_CELLS = 50000
# Splits of files read by one task, where Spark's source reads them.
SPLITS = 16
# Files, and bytes of files, that a task reads on average; bytes and rows of a batch it hands on.
TASK_FILES = 8192
TASK_BYTES = 64 * 1024 * 1024
BATCH_BYTES = 4 * 1024 * 1024
BATCH_ROWS = 10000
TEXT_SUFFIXES = ["txt", "md", "csv", "tsv", "json"]


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table stored as Parquet: one file or a directory of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines under a fixed schema; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_quarantine(
    spark: SparkSession, path: str, schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """Good rows, and malformed lines kept as text. Unknown fields make a line malformed."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    keys = F.array(*[F.lit(f.name) for f in schema.fields])
    parsed = lines.withColumn(
        "row",
        F.from_json("line", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]),
                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}),
    )
    extra = F.size(F.array_except(F.json_object_keys("line"), keys)) > 0
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull() | F.coalesce(extra, F.lit(True))
    good = parsed.filter(~bad).select(*[F.col(f"row.{f.name}").alias(f.name) for f in schema.fields])
    return good, parsed.filter(bad).select("line")


def _delimited(text: str | None, delimiter: str) -> str | None:
    if text is None:
        return None
    try:
        rows = csv.reader(io.StringIO(text), delimiter=delimiter)
        return "\n".join(" | ".join(row) for row in rows)
    except csv.Error:
        return None


@F.pandas_udf(T.StringType())
def _quoted_rows(text: pd.Series, delimiter: pd.Series) -> pd.Series:
    return pd.Series([_delimited(t, d) for t, d in zip(text, delimiter)], dtype=object)


def delimited_to_text(files: DataFrame) -> DataFrame:
    """Turn csv/tsv ``text`` into ``a | b`` lines in row order; other formats pass unchanged.

    Text without quotes is a plain replacement; only files with quotes (or stray carriage
    returns) go through the Arrow helper.
    """
    table = F.col("format").isin("csv", "tsv")
    mark = F.when(F.col("format") == "tsv", F.lit("\t")).otherwise(F.lit(","))
    odd = F.col("text").rlike('"|\r(?!\n)')
    plain = F.replace(
        F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), r"\n\z", ""), mark, F.lit(" | ")
    )
    return (
        files.withColumn("_quoted", F.when(table & odd, F.col("text")))
        .withColumn("_rows", _quoted_rows("_quoted", mark))
        .withColumn(
            "text",
            F.when(~F.coalesce(table, F.lit(False)), F.col("text"))
            .when(odd, F.col("_rows"))
            .otherwise(plain),
        )
        .drop("_quoted", "_rows")
    )


def text_problem(text: Column) -> Column:
    return (
        F.when(F.length(text) > MAX_CHARS, "extracted_text_limit")
        .when(text.rlike(r"(?U)\A[\s\x1c-\x1f]*+\z"), "no_inspectable_text")
        .when(F.contains(text, F.lit("\x00")), "unsupported_binary_content")
    )


def _hidden(path: str, folder: bool) -> bool:
    """Whether Spark's file sources pass over what has this name."""
    name = path.rsplit("/", 1)[-1]
    marked = name.startswith("_") and "=" not in name and not (folder and name.startswith(("_metadata", "_common_metadata")))
    return marked or name.startswith(".") or name.endswith("._COPYING_")


def _lister(base: str) -> Callable:
    """What the folders ``at`` hold: files with their bytes, folders without; empty files are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = fs.FileSystem.from_uri(base)[0]
        for batch in batches:
            for folder in batch.column("at").to_pylist():
                found = target.get_file_info(fs.FileSelector(folder))
                for start in range(0, len(found), BATCH_ROWS):
                    kept = [
                        (i.path, None if i.type == fs.FileType.Directory else i.size)
                        for i in found[start : start + BATCH_ROWS]
                        if (i.size or i.type == fs.FileType.Directory) and not _hidden(i.path, i.type == fs.FileType.Directory)
                    ]
                    yield pa.record_batch(
                        [pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.int64())], ["at", "bytes"]
                    )

    return run


def _reader(base: str, scheme: str) -> Callable:
    """The files ``at`` with their content; that of an over-long file is not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = fs.FileSystem.from_uri(base)[0]

        def record(rows: list) -> pa.RecordBatch:
            kinds = {"path": pa.string(), "length": pa.int64(), "content": pa.binary()}
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))

        held, total = [], 0
        for batch in batches:
            for at, size in zip(batch.column("at").to_pylist(), batch.column("bytes").to_pylist()):
                content = None
                if size <= MAX_BYTES:
                    with target.open_input_stream(at, compression=None) as file:
                        content = file.read()
                    total += len(content)
                held.append((scheme + at, size, content))
                if total >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                    yield record(held)
                    held, total = [], 0
        if held:
            yield record(held)

    return run


def _roots(spark: SparkSession, glob: str) -> tuple[str, str, list[fs.FileInfo]] | None:
    """What a glob names, the URI of its first and what stands before its paths; None if Arrow cannot open it."""
    given = spark._jvm.org.apache.hadoop.fs.Path(glob)
    try:
        store = given.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        named = spark._jvm.org.apache.spark.deploy.SparkHadoopUtil.get().globPathIfNecessary(store, store.makeQualified(given))
        paths = [named.apply(k) for k in range(named.size())]
        opened = [fs.FileSystem.from_uri(p.toUri().toASCIIString()) for p in paths]
        roots = [target.get_file_info(at) for target, at in opened]
    except (Py4JJavaError, OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None
    if not roots or any(r.type == fs.FileType.NotFound or not p.toString().endswith(r.path) for p, r in zip(paths, roots)):
        return None
    return paths[0].toUri().toASCIIString(), paths[0].toString().removesuffix(roots[0].path), roots


def _by_tasks(spark: SparkSession, base: str, scheme: str, roots: list[fs.FileInfo]) -> DataFrame:
    """``path, length, content`` of the files below the roots, listed level by level in tasks and read in others."""
    folders = [(r.path,) for r in roots if r.type == fs.FileType.Directory]
    plain = [(r.path, r.size) for r in roots if r.type != fs.FileType.Directory and r.size and not _hidden(r.path, False)]
    files = spark.createDataFrame(plain, "at string, bytes long")
    level = spark.createDataFrame(folders, "at string")
    cores = spark.sparkContext.defaultParallelism
    while not level.isEmpty():
        listed = stored(level.repartition(4 * cores).mapInArrow(_lister(base), "at string, bytes long"))
        files = files.unionByName(listed.filter(F.col("bytes").isNotNull()))
        level = listed.filter(F.col("bytes").isNull()).select("at")
    if len(roots) > 1:
        files = files.dropDuplicates(["at"])
    read = F.when(F.col("bytes") <= MAX_BYTES, F.col("bytes"))
    n, total = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(read), F.lit(0))).first()
    tasks = max(cores, n // TASK_FILES, total // TASK_BYTES)
    return files.repartition(tasks).mapInArrow(_reader(base, scheme), "path string, length long, content binary")


def _by_spark(spark: SparkSession, glob: str) -> DataFrame:
    """The same by Spark's own source, which lists the files in the driver.

    The size test is pushed into the file source, so the content of an over-long file is never
    read. Spark counts a small file as 4 MB, so its splits hold a few dozen; several splits make a
    task, as each task feeds the Arrow helper once.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob)
    tasks = max(spark.sparkContext.defaultParallelism, raw.rdd.getNumPartitions() // SPLITS)
    small = raw.filter(F.col("length") <= MAX_BYTES).coalesce(tasks).select("path", "length", "content")
    large = raw.filter(F.col("length") > MAX_BYTES).coalesce(tasks)
    return small.unionByName(large.select("path", "length", F.lit(None).cast("binary").alias("content")))


def read_files(spark: SparkSession, glob: str) -> DataFrame:
    """Bounded load of text-family files, one row each, with a reason code for every refusal.

    The driver sees what the glob names, not the files below: tasks list folders and read files,
    and the content of an over-long file is never read. A store that Arrow cannot open is left to
    Spark's own source.
    """
    named = _roots(spark, glob)
    raw = _by_tasks(spark, *named) if named else _by_spark(spark, glob)
    decoded = F.try_validate_utf8(F.col("content").cast("string"))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    read = (
        raw.select("path", suffix.alias("format"), F.col("length").alias("bytes"), "content")
        .withColumn("sha256", F.sha2("content", 256))
        .withColumn("_known", F.col("format").isin(*TEXT_SUFFIXES))
        .withColumn("text", F.when(F.col("_known"), F.regexp_replace(decoded, "\\A\ufeff", "")))
        .withColumn("_coded", F.col("text").isNotNull())
        .drop("content")
    )
    rows = delimited_to_text(read)
    error = (
        F.when(F.col("bytes") > MAX_BYTES, "upload_size_limit")
        .when(~F.col("_known"), "unsupported_document_format")
        .when(~F.col("_coded"), "unsupported_text_encoding")
        .when(F.col("text").isNull(), "document_extraction_failed")
        .otherwise(text_problem(F.col("text")))
    )
    return rows.withColumn("error", error).select(
        "path",
        "format",
        "bytes",
        F.when(F.col("error").isNull(), F.length("text")).alias("characters"),
        "sha256",
        F.when(F.col("error").isNull(), F.col("text")).alias("text"),
        F.col("error").isNull().alias("complete"),
        "error",
    )


def table_guard(cells: DataFrame) -> DataFrame:
    """Reason code per file from its cells ``(path, sheet, row, value)``; NULL when within caps."""
    per_sheet = cells.groupBy("path", "sheet").agg(
        F.max("row").alias("rows"),
        F.count(F.lit(1)).alias("cells"),
        F.sum(F.coalesce(F.length("value"), F.lit(0))).alias("chars"),
    )
    return (
        per_sheet.groupBy("path")
        .agg(
            F.max("rows").alias("rows"),
            F.sum("cells").alias("cells"),
            F.sum("chars").alias("chars"),
        )
        .withColumn(
            "error",
            F.when(F.col("rows") > MAX_ROWS, "spreadsheet_row_limit")
            .when(F.col("cells") > MAX_CELLS, "spreadsheet_cell_limit")
            .when(F.col("chars") > MAX_CHARS, "extracted_text_limit"),
        )
    )
