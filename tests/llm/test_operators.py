"""Each operator against brute force on small tables with nulls, empty and long texts, ties, copies and odd columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import ann, fingerprint, flat, html_text, line_dedup, mixing, near_dedup, packing, quality, queries, sharding, substring_dedup, suffixes
from dossier.llm.common import components

SCHEMA = "doc_id bigint, text string, source string, size int, id string"
WORDS = [f"w{k}" for k in range(400)]


def sample():
    rng = random.Random(5)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(30, 120))) for _ in range(30)]
    texts = [*base, None, "", " \n ", "One two", "ONE  two", "Ünïcödé " * 300, base[0], base[0], base[1].upper()]
    for k in range(8):  # near copies of one text
        words = base[2].split()
        words[5 + 7 * (k % 3)] = f"x{k}"
        texts.append(" ".join(words))
    texts += [base[3] + "\n" + base[4] + " tail", "head " + base[4] + "\n" + base[5]]
    rows = [(k, t, ("a", "b", None)[k % 3], 0, "z") for k, t in enumerate(texts)]
    return [*rows, rows[1], (None, base[0], "a", 0, "z"), (None, None, None, 0, "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def test_near_duplicates(docs, nothing):
    found = near_dedup.near_duplicates(docs, width=4).collect()
    rows = sample()
    sets = [shingle_set(r[1], 4) for r in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same_id or (sets[i] and 100 * both >= 80 * len(sets[i] | sets[j])):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    expected = sorted((str(r[0]), len(sets[k]), str(least.get(root(k)))) for k, r in enumerate(rows))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_fingerprints(docs, nothing):
    found = fingerprint.compared_with_next(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), rows_a_range=7).orderBy("doc_id").collect()
    texts = [r[1] or "" for r in sample()[:-3]]
    assert len(found) == len(texts)
    for r, text, after in zip(found, texts, [*texts[1:], texts[0]], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    by_text = {}
    for r, text in zip(found, texts, strict=True):
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert fingerprint.compared_with_next(nothing).count() == 0


def test_sampling_estimates_weighted_jaccard():
    rng = random.Random(1)
    a, b = [rng.choices(WORDS, k=300) for _ in range(2)]
    b[:150] = a[:150]
    buf, off = fingerprint._packed([" ".join(a), " ".join(b)])
    x = fingerprint.samples(buf, off, 2048)
    weight = [{w: len(w) * t.count(w) for w in t} for t in (a, b)]
    keys = weight[0].keys() | weight[1].keys()
    true = sum(min(weight[0].get(k, 0), weight[1].get(k, 0)) for k in keys) / sum(max(weight[0].get(k, 0), weight[1].get(k, 0)) for k in keys)
    assert abs(fingerprint.likeness(x[0], x[1]) - true) < 0.05


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    found = packing.pack_documents(docs.where("doc_id is not null"), tokenizer=path, capacity=64).collect()
    ids = {r[0]: np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in sample() if r[0] is not None}
    filled = {}
    for r in found:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = sum(len(ids[r[0]]) for r in sample() if r[0] is not None)
    assert sum(r.length for r in found) == total
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(filled) <= math.ceil(total / 64) * 1.03 + 1
    assert packing.pack_documents(nothing, tokenizer=path).count() == 0


@pytest.mark.parametrize("text", ["a  b\n\nc", "it's  we'll x y", " lead", "x  y z\u0085 w", "<|endoftext|> a <|endoftext|>b", "a\tb\r\nc é ü", "", "日本 語 text"])
def test_tokens_of_chunks_are_those_of_the_whole(text):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    raw = text.encode()
    ids, at = packing.Tokens(path)(np.frombuffer(raw * 2, np.uint8), np.array([0, len(raw), 2 * len(raw)]))
    expected = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert ids[: at[1]].tolist() == expected and ids[at[1] :].tolist() == expected


def test_plan_places_every_piece_once():
    rng = random.Random(2)
    histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, 1024), 300)}
    runs = packing.plan(histogram, 1024)
    ranks, room = {}, {}
    for n, rank, count, first, offset in sorted(runs):
        assert ranks.get(n, 0) == rank
        ranks[n] = rank + count
        for s in range(first, first + count):
            room.setdefault(s, []).append((offset, n))
    assert ranks == histogram
    for spans in room.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0 and sum(spans[-1]) <= 1024
    assert len(room) <= max(sum(c for n, c in histogram.items() if n > 512), math.ceil(sum(n * c for n, c in histogram.items()) / 1024) * 1.02 + 1)


def test_main_text(spark):
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>"
        "<div class='cookie-notice'><p>We use cookies to make this site better, please accept them.</p></div><article><h1>Title</h1><p>First &amp; foremost,\n a paragraph with <b>words.<br>"
        "<p>Short.</p><div class=ad>Buy now.</div><section id=comments><p>Great article, I loved reading all of it!</p></section></article><aside><p>Elsewhere on this site, more to read for you.</p></aside><footer>&copy; us</footer>"
    )
    assert html_text.main_text(page) == "Title\nFirst & foremost, a paragraph with words.\nShort."
    rows = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "", "x")], "page_id int, url string, html string, text string")
    found = html_text.extract_text(rows).collect()
    assert [(r.page_id, r.n_chars) for r in found][1:] == [(2, 0), (3, 0), (3, 0)]
    assert html_text.extract_text(rows.limit(0)).count() == 0


def test_minimum_cut_is_least():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 7)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(side, gain=gain, edges=edges):
            return sum(abs(g) for g, s in zip(gain, side, strict=True) if (g > 0) != s) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(2**n))
        assert abs(cost(html_text.minimum_cut(gain, edges)) - best) < 1e-6


def test_sharding(docs, nothing):
    found = sharding.shard_documents(docs, shards=3).collect()
    assert len(found) == len(sample())
    places, sizes = {}, {}
    for r in found:
        places.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(sizes.values()) - min(sizes.values()) <= max(r.size for r in found)
    expected = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in sample())
    assert sorted((r.size, r.text_crc32) for r in found) == expected
    assert sharding.shard_documents(nothing).count() == 0
    first = sharding.ShardMap.balanced({k: k for k in range(50)}, 4, 50)
    grown = first.grown({k: k for k in range(50)})
    moved = [k for k in range(50) if first.shard_of[k] != grown.shard_of[k]]
    assert moved and all(grown.shard_of[k] == 4 for k in moved) and grown.version == 2
    assert sharding.ShardMap.read(grown.frame(docs.sparkSession)) == grown


def test_kept_shard_maps_are_applied_again(docs, tmp_path):
    spark, maps = docs.sparkSession, str(tmp_path / "maps")
    first = {(r.doc_id, r.text_crc32): r.shard for r in sharding.shard_documents(docs, shards=3, maps=maps).collect()}
    sharding.ShardMap.latest(spark, maps).grown({k: 1 for k in range(4096)}).save(spark, maps)
    again = {(r.doc_id, r.text_crc32): (r.shard, r.map_version) for r in sharding.shard_documents(docs, shards=3, maps=maps).collect()}
    assert all(v == 2 and (s == first[k] or s == 3) for k, (s, v) in again.items())


def test_bounded_samples_are_the_least_by_digest(spark):
    from dossier.llm.common import sampled

    rows = spark.range(5000).withColumn("turn", F.md5(F.col("id").cast("string")))
    expected = [r.id for r in rows.orderBy("turn").limit(70).collect()]
    assert [r.id for r in sampled(rows, F.col("turn"), 70).collect()] == expected and sampled(rows.limit(9), F.col("turn"), 70).count() == 9


def test_linear_grouping_sorts_suffixes():
    rng = random.Random(3)
    for _ in range(400):
        text = bytes(rng.choices(b"abc"[: rng.randint(1, 3)], k=rng.randint(0, 40)))
        assert list(suffixes.suffix_array(text)) == sorted(range(len(text)), key=lambda k: text[k:])


@pytest.mark.parametrize("most", [2048, 2])
def test_substring_dedup(docs, nothing, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MOST_RUNS", most)
    monkeypatch.setattr(substring_dedup, "HOT_FROM", 6 if most > 2 else 1)
    length = 60
    rows = sample()
    found = substring_dedup.remove_repeats(docs, length=length, passage=40).collect()
    count = {}
    for _, t, *_ in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            count[raw[k : k + length]] = count.get(raw[k : k + length], 0) + 1
    expected = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if count[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        expected.append((str(i), len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == sorted(expected)
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_parts_that_share_different_strings():
    rng = random.Random(9)
    core = bytes(rng.choices(b"abcdefgh", k=80))
    parts = [core[:70] + b"!", core[5:75] + b"?", b"#" + core[10:80], core[20:60]]
    lead = [30, 25, 21, 10]
    found = substring_dedup.compare_runs(parts, lead, 40)
    for k, part in enumerate(parts):
        gone = set()
        for s in range(len(part) - 39):
            if any(part[s : s + 40] in other for j, other in enumerate(parts) if j != k):
                gone |= set(range(s, s + 40))
        assert gone == {b for s, e in found[k] for b in range(s, e)}


def test_line_dedup(docs, nothing):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    found = line_dedup.repeated_units(rows)
    listed = found.collect()
    texts = {r[0]: (r[1] or "").encode() for r in sample() if r[0] is not None}
    assert listed
    for r in listed:
        assert (r.first_doc_id, r.first_unit) < (r.doc_id, r.unit) and r.n_words >= 8
        assert len(texts[r.doc_id][r.start : r.start + r.length].split()) == r.n_words
    kept = line_dedup.without_units(rows, found).select("doc_id", "kept_text").collect()
    units = [u for r in kept for line in (r.kept_text or "").split("\n") for u in [" ".join(line.lower().split())] if len(u.split()) >= 8]
    assert len(units) == len(set(units))
    assert line_dedup.repeated_units(nothing).count() == 0


def test_line_dedup_finds_short_sentences_and_short_lines(spark):
    passage = "Yes it is. No. " + " ".join(f"Word{k} and more." for k in range(17)) + " The end."
    line = "licensed under the apache license, version 2.0."
    texts = ["Some first opening here. " + passage + " Then it goes on.", "Another start entirely. " + passage + " And stops here.", f"alpha beta\n{line}\ngamma", f"delta epsilon\n{line}\nzeta", "Just this. Only once."]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    kept = {r.doc_id: r.kept_text for r in line_dedup.without_units(rows, line_dedup.repeated_units(rows)).collect()}
    assert [kept[0], kept[2], kept[4]] == [texts[0], texts[2], texts[4]]
    assert kept[1].split() == "Another start entirely. And stops here.".split() and kept[3] == "delta epsilon\n\nzeta"


def test_mixing(docs, nothing):
    found = mixing.mix_sources(docs).collect()
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in sample())
    targets = {(r.source_size, r.target) for r in found}
    assert abs(sum(t for _, t in targets) - total) < 1e-6 and all(t <= 3 * s + 1e-9 for s, t in targets)
    for size, target in targets:
        taken = sum(r.taken for r in found if r.source_size == size)
        assert abs(taken - target) <= 1
    assert all(r.taken <= 3 * r.size for r in found)
    again = mixing.mix_sources(docs.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert mixing.mix_sources(nothing).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(nothing).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:60] = x[40]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0] * 3), (1080, [float("inf")] + [1.0] * 7)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    exact = x.astype(float) @ x.astype(float).T
    hits = total = 0
    for q in range(0, 300, 20):
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        best = sorted((k for k in range(300) if k != q), key=lambda k: (-exact[q, k], k))[:20]
        hits, total = hits + len(set(best) & {r.vec_id for r in own}), total + 20
    assert hits / total >= 0.9 and len(found) == total
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert [(r.vec_id, r.score) for r in ann.nearest(few).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0)]
    assert ann.nearest(few.limit(0)).count() == 0


def test_quality(spark, docs, nothing):
    sf = "/root/testdata/sf0.001"
    found = queries.op10_quality(spark, sf).collect()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    known = [(r.predicted, labels[r.doc_id]) for r in found if r.doc_id in labels]
    assert sum(p == q for p, q in known) / len(known) > 0.85
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(nothing, none).count() == 0


def test_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.grow(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.93


def test_statistics_of_empty_texts_are_zero():
    buf, off = fingerprint._packed(["", "A b. c!\nd", ""])
    stats = quality.statistics(buf, off)
    assert stats.shape == (3, len(quality.FEATURES)) and not stats[[0, 2]].any() and stats[1, 0] == np.float32(np.log1p(4))


def test_word_kernel():
    texts = ["", "  a b", "c", "\td\x0be ", "é f"]
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    buf = np.frombuffer(b"".join(raw), np.uint8)
    start, end, row = flat.words(buf, off)
    found = [(int(r), bytes(buf[s:e])) for s, e, r in zip(start, end, row, strict=True)]
    assert found == [(k, w) for k, r in enumerate(raw) for w in re.findall(rb"[^\x20\x09-\x0D]+", r)]
