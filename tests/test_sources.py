import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietgate.sources import readers, sinks

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def test_read_jsonl_is_strict(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id":1,"name":"x"}\n{"id":2,"name":"y"}\n')
    assert readers.read_jsonl(spark, str(path), SCHEMA).count() == 2
    path.write_text('{"id":1,"name":"x"}\n{broken\n{"id":"q","name":"y"}\n{"id":3,"name":"z","extra":1}\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(path), SCHEMA).collect()
    good, bad = readers.read_jsonl_quarantine(spark, str(path), SCHEMA)
    assert [r.id for r in good.collect()] == [1]
    assert bad.count() == 3


FILES = {
    "ok.txt": (b"hello", "hello", None),
    "bom.md": ("﻿제목".encode(), "제목", None),
    "plain.csv": (b"a,b\r\nc,d\n", "a | b\nc | d", None),
    "quoted.csv": (b'a,"b,\nx"\n"c ""d""",e\n', 'a | b,\nx\nc "d" | e', None),
    "tabs.tsv": (b"a\tb,c\n", "a | b,c", None),
    "blank.txt": (" \n　".encode(), None, "no_inspectable_text"),
    "nul.txt": (b"a\x00b", None, "unsupported_binary_content"),
    "latin.txt": (b"\xff\xfe", None, "unsupported_text_encoding"),
    "long.txt": (b"a" * 60001, None, "extracted_text_limit"),
    "edge.txt": (b"a" * 60000, "a" * 60000, None),
    "huge.txt": (b"a" * (4 * 1024 * 1024 + 1), None, "upload_size_limit"),
    "photo.png": (b"x", None, "unsupported_document_format"),
    "data.JSON": (b'{"a":1}', '{"a":1}', None),
}


def test_read_files(spark, tmp_path):
    for name, (data, _t, _e) in FILES.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert set(rows) == set(FILES)
    for name, (data, text, error) in FILES.items():
        r = rows[name]
        assert (r.text, r.error, r.bytes, r.complete) == (text, error, len(data), error is None), name
        assert (r.characters, r.sha256 is None) == (len(text) if text else None, name == "huge.txt")


def test_table_guard(spark):
    cells = spark.range(50001).select(
        F.lit("many").alias("path"), F.lit("s").alias("sheet"), F.lit(1).alias("row"), F.lit("").alias("value")
    )
    extra = spark.createDataFrame([("tall", "s", 10001, "x"), ("wide", "s", 1, "x" * 60001), ("ok", "s", 10000, None)], "path string, sheet string, row int, value string")
    got = {r.path: r.error for r in readers.table_guard(cells.unionByName(extra)).collect()}
    assert got == {"many": "spreadsheet_cell_limit", "tall": "spreadsheet_row_limit", "wide": "extracted_text_limit", "ok": None}


def test_write_splits(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", "train", "f", "d", "a"), ("2", "test", "g", "e", "b")],
        "id string, split string, source_family string, document_id string, text string",
    )
    out = str(tmp_path / "out")
    manifest = {r.split: r.rows for r in sinks.write_splits(df, out).collect()}
    assert manifest == {"train": 1, "test": 1}
    parts = list((tmp_path / "out").glob("split=train/*.json"))
    assert [json.loads(line)["id"] for p in parts for line in p.read_text().splitlines()] == ["1"]
    with pytest.raises(Exception):
        sinks.write_splits(df, out)


def test_append_audit(spark, tmp_path):
    path = str(tmp_path / "audit")
    events = spark.createDataFrame(
        [(7_200_000, "h", "POST", 1, "clean", "allow"), (5, "h", "GET", 1, "clean", "allow"), (9, "h", "GET", 2, "clean", "allow")],
        "timestamp_ms long, host string, method string, body_len long, reason string, action string",
    )
    sinks.append_audit(events, path)
    with pytest.raises(Exception):
        sinks.append_audit(events, path)
    sinks.append_audit(events.limit(1), path, new=False)
    log = spark.read.parquet(path).orderBy("event_id").collect()
    assert [r.event_id for r in log] == [1, 2, 3, 4]
    assert [r.timestamp_ms for r in log[:3]] == [5, 9, 7_200_000]
    with pytest.raises(ValueError):
        sinks.append_audit(events.withColumn("text", F.lit("secret")), path, new=False)


def test_write_texts(spark, tmp_path):
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    odd = spark.createDataFrame([(-5, None), (7, "again")], "doc_id long, text string")
    out = (tmp_path / "out").as_uri()
    sinks.write_texts(ids.unionByName(odd), out, "doc_id", "text")
    assert len(list((tmp_path / "out").iterdir())) <= sinks.FOLDERS
    files = readers.read_files(spark, out)
    assert files.rdd.getNumPartitions() <= max(2 * spark.sparkContext.defaultParallelism, 3001 // readers.SPLITS)
    rows = {r.path.rsplit("doc_id=", 1)[1]: r for r in files.collect()}
    assert len(rows) == 3001
    assert rows["12.txt"].text == "t12\n" and rows["12.txt"].error is None
    assert sorted(rows["7.txt"].text.split()) == ["again", "t7"]
    assert (rows["-5.txt"].bytes, rows["-5.txt"].error) == (1, "no_inspectable_text")


def test_read_files_lists_in_tasks_what_spark_lists_in_the_driver(spark, tmp_path):
    for name in (
        "a.txt", "_a.txt", "_k=1.txt", ".h.txt", "x._COPYING_", "sub/b.md", "sub/_hid/c.txt", "sub/.hid/c.txt",
        "sub/_metadata/m.txt", "sub/_metadata/_metadata", "sub/_k=2/c.txt", "sub/deep/er/e \u00fc%41.txt", "a.txt.gz", "noext",
    ):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b'a,b\n"1,2",c\n')
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "huge.txt").write_bytes(b"a" * (4 * 1024 * 1024 + 1))
    sort = lambda df: sorted(map(tuple, df.select("path", "length", "content").collect()), key=str)
    for glob in (str(tmp_path), f"{tmp_path}/*", f"{tmp_path}/*.txt", f"{tmp_path}/{{sub,sub/deep}}", f"{tmp_path}/sub/_hid"):
        named = readers._roots(spark, glob)
        assert sort(readers._by_tasks(spark, *named)) == sort(readers._by_spark(spark, glob)), glob
    plan = readers.read_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_files(spark, f"{tmp_path}/none")


def test_write_texts_shuffles_only_texts_of_repeated_keys(spark):
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    odd = spark.createDataFrame([(None, "x"), (None, None), (7, "again")], "doc_id long, text string")
    alone, several = sinks._dealt(ids.unionByName(odd), "doc_id", "text")
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    held = sorted((r.name, r.text or "") for r in several.collect())
    assert {("7", "t7"), ("7", "again"), ("null", "x"), ("null", "")} <= set(held) and len(held) < 100
    assert alone.count() + len(held) == 3003
    assert alone.select("name").distinct().count() == alone.count()
