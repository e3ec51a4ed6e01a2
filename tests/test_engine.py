"""The whole way on small folders: settings, reading, checking, writing, kept results, comparing."""

import pytest
from pyspark.sql import functions as F

from dossier import config, engine
from dossier.memo import Memo
from test_pdf import document

STOP = [("en", w) for w in "the of and to a in that is was it for on with as be at by this".split()]


def test_settings(tmp_path):
    assert config.load(None)["ocr"]["languages"] == ["eng"]
    (tmp_path / "a" / "b").mkdir(parents=True)
    file = tmp_path / config.FILE
    file.write_text('title = "T"\n[render]\ndpi = 300\n')
    assert config.find(tmp_path / "a" / "b") == file and config.load(file)["render"]["dpi"] == 300
    for bad in ('titel = "x"', "[render]\ndpi = 9", "[render]\nwidths = []", "[search]\nenabled = 1", '[ocr]\nmode = "often"', 'base_url = "x.org"', "[safety\n"):
        file.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(file)


def _page(lines, box=b""):
    text = b" ".join(b"(%s) Tj 0 -20 Td" % line for line in lines)
    return b"BT /F1 10 Tf 60 740 Td " + text + b" ET " + box


def test_a_folder_becomes_tables(spark, tmp_path):
    lines = [b"the report of the office", b"it was read on the day \\(b\\)\\(5\\)", b"name of the person is Jane"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.pdf").write_bytes(document(_page(lines), _page([b"a second page of the report"])))
    (tmp_path / "in" / "notes.txt").write_text("for the operator")
    stopwords = spark.createDataFrame(STOP, "lang string, word string")
    paths = engine.build(spark, str(tmp_path / "in"), str(tmp_path / "out"), config.load(None), stopwords)
    back = {k: spark.read.parquet(p) for k, p in paths.items()}
    assert back["pages"].count() == 2 and {r.language for r in back["pages"].collect()} == {"en"}
    assert [r.code for r in back["codes"].collect()] == ["b(5)"] and back["words"].where("text = 'Jane'").count() == 1
    assert engine.index_language(back["pages"]) == "en" and engine.index_language(back["pages"], "fr") == "fr"


def test_a_leak_stops_the_build(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bad.pdf").write_bytes(document(_page([b"Jane Roe"], b"0 g 50 730 100 30 re f")))
    stopwords = spark.createDataFrame(STOP, "lang string, word string")
    with pytest.raises(engine.SafetyStop):
        engine.build(spark, str(tmp_path / "in"), str(tmp_path / "out"), config.load(None), stopwords)
    assert not (tmp_path / "out").exists()
    warn = config.load(None) | {"safety": {"hidden_text": "warn", "publish_originals": True, "strip_metadata": False}}
    paths = engine.build(spark, str(tmp_path / "in"), str(tmp_path / "out"), warn, stopwords)
    assert [r.text for r in spark.read.parquet(paths["leaks"]).collect()] == ["Jane Roe"]
    assert spark.read.parquet(paths["words"]).count() == 0


def test_kept_results(spark, tmp_path):
    memo = Memo(spark, str(tmp_path / "memo"), budget=9)
    work = spark.createDataFrame([("aa1",), ("bb2",), ("cc3",)], "key string")
    assert [r.result for r in memo.get(work).collect()] == [None] * 3
    memo.put(spark.createDataFrame([("aa1", "12345", None), ("bb2", "1234", None), ("cc3", "1", "error")], "key string, result string, refusal string"))
    assert {r.key: r.result for r in memo.get(work).collect()} == {"aa1": "12345", "bb2": "1234", "cc3": None}
    memo.put(spark.createDataFrame([("cc3", "678", None)], "key string, result string, refusal string"))
    assert memo.stats().first()["n_entries"] == 3
    memo.prune()
    assert {r.key for r in memo.entries().collect()} == {"cc3", "aa1"} and memo.stats().first()["bytes"] == 8
    memo.clear()
    assert memo.entries().count() == 0


def test_two_releases_are_compared(spark):
    text = "the office sent this letter to the person named below and asked for an answer within ten days of the date on it".split()
    words = lambda doc, changed: [(doc, p, k, ("Zoe" if changed and k == 9 and p == 1 else f"{w}{p}" if k % 5 == 0 else w), k // 6, (k % 6) / 6, (k // 6) / 20 + 0.1, 0.1, 0.03, 90) for p in (1, 2) for k, w in enumerate(text)]
    kind = "doc_id string, page int, pos int, text string, line int, x double, y double, w double, h double, conf int"
    box = "doc_id string, page int, rid int, kind string, x double, y double, w double, h double"
    old = {"words": spark.createDataFrame([w for w in words("a", False) if not (w[1] == 1 and w[2] == 9)], kind), "redactions": spark.createDataFrame([("a", 1, 0, "vector", 0.49, 0.14, 0.13, 0.05)], box)}
    new = {"words": spark.createDataFrame(words("b", True), kind), "redactions": spark.createDataFrame([], box)}
    docs = lambda t, name: t["words"].groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text")).withColumn("name", F.lit(name))
    scores = engine.document_scores(docs(old, "Letter.pdf"), docs(new, "letter.pdf"))
    assert scores.first()["score"] > 0.45
    out = engine.compared(old, new, spark.createDataFrame([("a", "b")], "a string, b string"))
    assert out["verdicts"].first()["refusal"] is None
    assert [(r.kind, r.page) for r in out["changes"].collect()] == [("removed", 1)]
    assert [(r.direction, r.text, r.confidence) for r in out["findings"].collect()] == [("disclosed", "Zoe", "corroborated")]
