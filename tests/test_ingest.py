"""Files, delimiters, pages and the streaming sink."""

import pytest
from pyspark.sql import functions as F

from sheafline.operators import documents as D
from sheafline.sources import files, tiles
from sheafline.streaming import events, ingest, keyed_store


def test_files_are_detected(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"{\\rtf1 x}")
    (tmp_path / "b.docm").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "c.csv").write_bytes(b"a;b\n1;2\n")
    (tmp_path / "d.dat").write_bytes(b"junk %PDF-1.7")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert {k: r["format"] for k, r in rows.items()} == {"a.bin": "rtf", "b.docm": "docx", "c.csv": "csv", "d.dat": "pdf"}
    small = files.read_files(spark, str(tmp_path), max_bytes=9).where("error_code is not null")
    assert {r["error_code"] for r in small.collect()} == {"resourceLimit"}


def test_decoding(spark):
    cases = [("é".encode(), "é"), ("é".encode("utf-16"), "é"), (b"\xef\xbb\xbfx", "x"), (b"caf\xe9", "café"), (b"", "")]
    own = spark.createDataFrame([(b,) for b, _ in cases], "content binary")
    assert [r[0] for r in own.select(files.decoded(F.col("content"))).collect()] == [t for _, t in cases]


def test_delimited(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a;b;c\n1,5;2;3\n4;5,5;6\n")
    got = files.read_delimited(spark, str(path))
    assert got.columns == ["a", "b", "c"] and [tuple(r) for r in got.collect()] == [("1,5", "2", "3"), ("4", "5,5", "6")]


def test_pages(spark):
    html = "<html><head><title>t</title></head><body><h2>A &amp; B</h2><p>one <b>two<br>three<p>four<ul><li><a href='x'>q</a><li>r</ul><script>no</script></body>"
    own = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    got = {r["page_id"]: r["markdown"] for r in D.html_markdown(own).collect()}
    assert got == {1: "## A & B\n\none two three\n\nfour\n\n- [q](x)\n- r", 2: ""}


def test_stream_stores_each_content_once(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "doc_id long, text string")
    first.write.parquet(source)
    for _ in range(2):
        ingest.ingest_stream(spark, source, first.schema, target, check).awaitTermination()
    spark.createDataFrame([(5, "b"), (6, "c")], first.schema).write.mode("append").parquet(source)
    ingest.ingest_stream(spark, source, first.schema, target, check).awaitTermination()
    store = keyed_store.KeyedStore(spark, target)
    assert sorted(r["text"] or "" for r in store.rows().collect()) == ["", "a", "b", "c"]
    # a batch that runs again adds nothing
    batch = spark.createDataFrame([(6, "c"), (7, "d")], first.schema)
    assert [store.write(ingest.keyed(batch), 99) for _ in range(2)] == [1, 0]
    assert store.rows().count() == 5


def test_two_writers_never_both_store_a_key(spark, tmp_path):
    one, two = (keyed_store.KeyedStore(spark, str(tmp_path / "s"), "k", buckets=4) for _ in range(2))
    rows = lambda who, *keys: spark.createDataFrame([(k, who) for k in keys], "k string, who string")
    claim = one._claim

    def late(number, attempt):
        one._claim = claim
        two.write(rows("two", "b", "c"), 2)  # between the first one's look at the store and its claim
        return claim(number, attempt)

    one._claim = late
    assert one.write(rows("one", "a", "b", "b"), 1) == 1
    assert sorted(map(tuple, one.rows().collect())) == [("a", "one"), ("b", "two"), ("c", "two")]
    assert two.write(rows("three", "a", "c"), 3) == 0 and two.last() == 3
    # only the folders of a batch's keys are read
    plan = one.rows([1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]


def test_a_lost_claim_counts_as_none(spark, tmp_path, monkeypatch):
    store = keyed_store.KeyedStore(spark, str(tmp_path / "s"), "k")
    rows = spark.createDataFrame([("a", 1)], "k string, v long")
    assert store.write(rows, 1) == 1
    (tmp_path / "s" / "log" / "000000000002").touch()
    monkeypatch.setattr(keyed_store, "LOST_S", -1)
    assert store.write(spark.createDataFrame([("b", 1)], "k string, v long"), 2) == 1 and store.last() == 3


def test_a_rectangle_reads_few_files(spark, tmp_path):
    path = str(tmp_path / "cells")
    rows = spark.range(400_000).select(F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("sheet"), (F.floor(F.col("id") / 4) + 1).alias("row"), (F.col("id") % 3 + 1).alias("col"), F.col("id").alias("num"))
    tiles.write_tiles(rows, path, files=32)
    got = tiles.inspect(spark, path, "s2", (70_000, 2, 70_009, 3))
    assert [r["row"] for r in got.collect()] == [r for r in range(70_000, 70_010) if (4 * (r - 1) + 2) % 3 != 0]
    leaf = tiles.read_rectangle(spark, path, "s2", (70_000, 2, 70_009, 3))
    leaf.collect()
    scan = leaf._jdf.queryExecution().executedPlan().collectLeaves().head()
    read, every = scan.metrics().apply("numFiles").value(), len(spark.read.parquet(path).inputFiles())
    assert read < every / 3
    with pytest.raises(ValueError):
        tiles.inspect(spark, path, "s2", (1, 1, 1000, 101))
    rects = spark.createDataFrame([("x", "s1", 1, 1, 3, 9), ("y", "s3", 99_999, 1, 100_005, 1), ("z", "no", 1, 1, 9, 9)], "rect string, sheet string, top long, left long, bottom long, right long")
    assert sorted((r["rect"], r["row"]) for r in tiles.read_rectangles(spark, path, rects).collect()) == [("x", 1), ("x", 2), ("x", 3), *(("y", r) for r in (99_999, 100_000) if (4 * (r - 1) + 3) % 3 == 0)]


def test_containment(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, ""), (3, None)], "doc_id long, text string")
    probes = spark.createDataFrame([(9, "B C D e"), (8, "z")], "item_id long, text string")
    assert [tuple(r) for r in D.containment(docs, probes).collect()] == [(1, 9, 0.5)]


def test_windows_of_a_stream_close_by_the_watermark(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = spark.createDataFrame([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 2.0), ("b", "2024-01-01 01:05:00", 3.0)], "event_type string, t string, value double")
    rows = rows.select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    rows.write.parquet(source)
    events.window_stream(spark, source, rows.schema, target, check).awaitTermination()
    rows.select((F.col("ts") + F.expr("interval 3 hours")).alias("ts"), "event_type", "value").write.mode("append").parquet(source)
    for _ in range(2):
        events.window_stream(spark, source, rows.schema, target, check).awaitTermination()
    got = {(str(r["start"]), r["event_type"]): (r["n"], r["total"]) for r in spark.read.parquet(target).collect()}
    whole = {(str(r["start"]), r["event_type"]): (r["n"], r["total"]) for r in events.windowed(rows).collect()}
    assert got and got.items() <= {**whole, **got}.items() and all(got[k] == whole[k] for k in got if k in whole)
    assert ("2024-01-01 00:00:00", "a") in got


def test_windows_text_and_other_columns(spark):
    own = spark.createDataFrame([(b"\x80 \x93x\x94 \x81",)], "blob binary")
    assert own.select(files.decoded(F.col("blob"))).first()[0] == "€ “x” \x81"


def test_files_over_a_bound_or_of_no_known_format(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x" * 50)
    (tmp_path / "b.csv").write_bytes(b"1,2")
    (tmp_path / "c.what").write_bytes(b"1,2")
    got = {r["path"].rsplit("/", 1)[1]: (r["format"], r["error_code"], r["n_bytes"]) for r in files.read_files(spark, str(tmp_path), 20).collect()}
    assert got == {"a.csv": (None, "resourceLimit", 50), "b.csv": ("csv", None, 3), "c.what": (None, "unsupported", 3)}
    assert {r["format"] for r in files.read_files(spark, str(tmp_path), 20, explicit="csv").collect()} == {"csv", None}


def test_delimited_rows(spark):
    texts = [(1, 'a,"b\nc"\n\n1,2,3', ","), (2, '"never closed', ","), (3, None, ","), (4, "x;y\nz", ";"), (5, "a\nb\nc\nd", ",")]
    got = sorted(map(tuple, files.delimited_rows(spark.createDataFrame(texts, "k int, text string, delimiter string"), "k", max_rows=3).collect()), key=str)
    assert got == [(1, 0, ["a", "b\nc"], None), (1, 1, ["1", "2", "3"], None), (2, None, None, "malformed"), (4, 0, ["x", "y"], None), (4, 1, ["z"], None), (5, None, None, "resourceLimit")]
