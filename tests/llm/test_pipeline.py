"""The pipeline's stages on the smallest tables."""

import random

import corpus_pipeline
from dossier.llm import queries


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[5] >= counts[4]
    assert set(queries.ORACLE) <= set(queries.QUERIES) and {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries.QUERIES}


def test_substring_stage_cuts_passages_of_just_over_50_words(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 6))) for _ in range(n))
    passages = {n: words(n) for n in range(51, 61)}
    own = {(n, k): (words(40), words(40)) for n in passages for k in (0, 1)}
    rows = [(2 * n + k, f"{head} {passages[n]} {tail}") for (n, k), (head, tail) in own.items()]
    assert all(len(p) < 400 for p in passages.values())
    left = {r.doc_id: r.text for r in corpus_pipeline.substring_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()}
    for (n, k), (head, tail) in own.items():
        text = left[2 * n + k]
        assert passages[n] not in text and len(text) < len(head) + len(tail) + 8  # some bytes beside the passage may agree by chance
        assert text.startswith(head[:-8]) and text.endswith(tail[8:])


def test_substring_stage_drops_only_rows_that_it_empties(spark):
    same = " ".join(f"w{k}" for k in range(80))
    rows = [(0, None), (1, ""), (2, "   "), (3, same), (4, same), (5, "short")]
    left = corpus_pipeline.substring_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(0, None), (1, ""), (2, "   "), (5, "short")]


ODD = "doc_id bigint, text string, source string, _id string, id int, th string, spans string, row string, meta map<string, string>, n_chars int"


def odd_rows():
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(n))
    texts = [words(120) for _ in range(12)] + [None, "", " \n ", "x" * 5000, words(30_000)]
    rows = [(k, t, ("a", None)[k % 2], "i", 1, "t", "s", "r", {"k": "v"}, 0) for k, t in enumerate(texts)]
    return [*rows, rows[2], (90, texts[3], "a", "i", 1, "t", "s", "r", {}, 0), (None, texts[4], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


def test_stages_take_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, map columns and names that the operators use themselves."""
    docs = spark.createDataFrame(odd_rows(), ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns, name
        if name == "near_dedup":
            kept = [r.doc_id for r in rows if r.doc_id is not None]
            assert sorted(kept) == list(range(17)) and len(rows) == 18  # 2 and 90 are copies; one row without an id stays
        if name == "substring_dedup":
            assert {12, 13, 14} <= {r.doc_id for r in rows} and not {2, 3, 90} & {r.doc_id for r in rows}
        if name == "packing":
            assert len({(r.doc_id, r.piece) for r in rows if r.doc_id is not None}) == len([r for r in rows if r.doc_id is not None]) - 1 + (len(rows) == 0)
        stage(spark, docs.limit(0), "/root/testdata/sf0.001").collect()


def test_stages_keep_what_brute_force_keeps(spark):
    """On planted rows: rejects by score, one row of each class of near copies, whole documents by the mix's own counts."""
    from dossier.llm.mixing import mix_sources
    from dossier.llm.quality import score_quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted}
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).collect()} == good

    def grams(text):
        w = text.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    texts = {r.doc_id: grams(r.text) for r in docs.collect()}
    root = {k: k for k in texts}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in texts:
        for b in texts:
            if a < b and 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()} == {k for k in root if root[k] == k}

    mixed, size = {}, {}
    for r in corpus_pipeline.mixing(spark, docs, sf).collect():
        mixed[r.source] = mixed.get(r.source, 0) + len(r.text.split())
    target = {}
    sources = {r.doc_id: r.source for r in docs.collect()}
    for r in mix_sources(docs).collect():
        target[sources[r.doc_id]] = r.target
        size[sources[r.doc_id]] = max(size.get(sources[r.doc_id], 0), r["size"])
    assert all(abs(mixed.get(s, 0) - t) <= size[s] for s, t in target.items())
