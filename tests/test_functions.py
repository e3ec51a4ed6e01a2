"""Expressions and operators on small inputs."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import formats, text
from dossier.operators import compare, series
from dossier.sources import files
from dossier.streaming import watch


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_normalising_and_folding(spark):
    rows = [("“L’Homme”,",), ("well–known",), ("U.S.C.",), ("…",)]
    assert values(spark, rows, "t string", text.normalized(F.col("t"))) == ["l'homme", "well-known", "u.s.c", ""]
    assert values(spark, [("STRASSE",), ("Straße",), ("ﬁn.",)], "t string", text.normalized_unicode(F.col("t"))) == ["strasse", "strasse", "fin"]
    assert values(spark, [("Modern",), ("m0dem",), (",",)], "t string", text.skeleton(F.col("t"))) == ["modem", "modem", "·"]


def test_garbage_tokens(spark):
    rows = [("strengths",), ("xxxxx",), ("a.b,c;d",), ("bcdfg",), ("1999",), ("aeiou",), ("",)]
    assert values(spark, rows, "t string", text.is_garbage(F.col("t"))) == [False, True, True, True, False, True, True]


def test_slugs_and_natural_order(spark):
    rows = [("Été à Paris!",), ("con",), ("文書",)]
    assert values(spark, rows, "t string", text.slug(F.col("t"))) == ["ete-a-paris", "con-doc", "doc"]
    names = spark.createDataFrame([("doc10",), ("doc2",), ("Doc1",)], "name string")
    assert [r.name for r in names.orderBy(text.natural_key(F.col("name")), "name").collect()] == ["Doc1", "doc2", "doc10"]


def test_formats(spark):
    n = [(1,), (2,), (5,), (21,), (12,)]
    assert values(spark, n, "n bigint", formats.plural("east_slavic", F.col("n"))) == ["one", "few", "many", "one", "many"]
    with pytest.raises(ValueError):
        formats.plural("none such", F.col("n"))
    assert values(spark, [(999,), (1234567,), (-4321,)], "n bigint", formats.grouped(F.col("n"))) == ["999", "1,234,567", "-4,321"]
    assert values(spark, [("5GB",), ("1.5 k",), ("apples",)], "t string", formats.parse_size(F.col("t"))) == [5 * 1024**3, 1536, None]
    assert values(spark, [("D:20240102030405+02'00'",), ("soon",)], "t string", formats.pdf_date(F.col("t"))) == ["2024-01-02T03:04:05+02:00", "soon"]


def test_series(spark):
    stamps = spark.createDataFrame([("a", 1), ("a", 2), ("a", 6), ("a", 6), ("b", 9)], "series string, value bigint")
    assert [tuple(r) for r in series.gaps(stamps).collect()] == [("a", 3, 5, 3)]
    assert series.coverage(stamps).where("series = 'a'").first()["n_missing"] == 3


def test_greedy_matching(spark):
    pairs = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.85), (2, 2, 0.4), (3, 3, 0.1)], "a int, b int, s double")
    assert sorted(tuple(r) for r in compare.mutual_best(pairs, "s", 0.3).collect()) == [(1, 1, 0.9), (2, 2, 0.4)]


def test_file_scan(spark, tmp_path):
    (tmp_path / "doc10.pdf").write_bytes(b"%PDF-1.4 a")
    (tmp_path / "doc2.pdf").write_bytes(b"%PDF-1.4 a")
    (tmp_path / "fake.pdf").write_bytes(b"hello")
    (tmp_path / "scan.png").write_bytes(b"\x89PNG\r\n\x1a\n...")
    usable, skipped = files.discover(spark, str(tmp_path), exclude=["*.png"])
    assert [(r.name, r.slug, r.kind) for r in usable.collect()] == [("doc2.pdf", "doc2", "pdf")]
    assert {r.name: r.reason for r in skipped.collect()} == {"doc10.pdf": "same bytes as doc2.pdf", "fake.pdf": "unsupported type", "scan.png": "excluded"}


def test_snapshots_and_bursts(spark):
    before = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, size int, modified int")
    after = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, size int, modified int")
    assert {tuple(r) for r in watch.changes(before, after).collect()} == {("b", "modified"), ("c", "removed"), ("d", "added")}


def test_burst_stream(spark, tmp_path):
    rows = spark.createDataFrame([("k", s) for s in (0, 1, 10, 100)], "key string, s int").select("key", F.timestamp_seconds("s").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = watch.settled_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "5 seconds", "1 second")
    query = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.n_events for r in spark.table("bursts").collect()) == [1, 2]
