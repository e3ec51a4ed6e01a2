"""Inputs that are made to break things: colliding words, extreme ids, repeated rows, long pages, odd columns."""

import random
import time
import zlib

import numpy as np
import pytest

from dossier.llm import ann, fingerprint, flat, html_text, line_dedup, near_dedup, packing, quality, queries


def opposites(n: int) -> tuple[str, str]:
    """Two words of n letters that collide under polynomials modulo a power of two."""
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


def test_span_hashes_and_names_tell_opposites_apart():
    for n in (8, 64, 1024):
        raw = "".join(opposites(n)).encode()
        buf, start = np.frombuffer(raw, np.uint8), np.array([0, n])
        first, second = flat.span_hash(buf, start, start + n)
        assert first != second and len(set(flat.names(buf, start, start + n))) == 2
        assert flat.same_bytes(buf, start, start + n, np.array([0, 0])).tolist() == [True, False]


def test_span_hashes_don_t_depend_on_what_stands_around():
    raw = b"x" + b"some words" + b"yy" + b"some words" + b"z" * 90 + b"q" + b"z" * 90
    buf = np.frombuffer(raw, np.uint8)
    start = np.array([1, 13, 23, 114])
    found = flat.span_hash(buf, start, start + np.array([10, 10, 90, 90]))
    assert found[0] == found[1] and found[2] == found[3] != found[0]


def test_packing_reads_opposites_right(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = [f"one {w} two" for w in opposites(1024)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    tokenizer = Tokenizer.from_file(path)
    for r in packing.pack_documents(rows, tokenizer=path).collect():
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_opposites_are_no_duplicates(spark):
    a, b = opposites(1024)
    rows = spark.createDataFrame([(0, a), (1, b), (2, f"{a} x y z"), (3, f"{b} x y z")], "doc_id bigint, text string")
    assert all(r.kept for r in near_dedup.near_duplicates(rows, width=4).collect())
    units = spark.createDataFrame([(0, " ".join([a] * 9)), (1, " ".join([b] * 9))], "doc_id bigint, text string")
    assert line_dedup.repeated_units(units).where("doc_id <> first_doc_id").count() == 0


def test_near_duplicates_in_many_small_blocks(spark, monkeypatch):
    """Every pair of blocks meets: small blocks give the same classes as large ones."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(40):
        words = list(base)
        for p in rng.sample(range(60), 3):
            words[p] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    large = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(rows, width=4).collect()}
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 2)
    assert large == {r.doc_id: r.component_id for r in near_dedup.near_duplicates(rows, width=4).collect()}


def test_repeated_rows_lose_all_but_one_unit(spark):
    line = "this line of more than eight words stands in all of these rows"
    rows = spark.createDataFrame([(1, line, "s"), (1, line, "s"), (2, line, "s")], "doc_id bigint, text string, spans string")
    removed = line_dedup.repeated_units(rows)
    assert sorted((r.doc_id, r["copy"]) for r in removed.collect()) == [(1, 1), (2, 0)]
    kept = line_dedup.without_units(rows, removed)
    assert kept.columns == ["doc_id", "text", "spans", "kept_text"]
    assert sorted(r.kept_text for r in kept.collect()) == ["", "", line]


def test_fingerprints_of_any_ids(spark):
    ids = [-(2**63) + 1, -5, 0, 3, 2**62, 2**63 - 1]
    texts = ["one text here", "", "another one", "one text here", "more words in this one", "the last"]
    found = fingerprint.compared_with_next(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string"), rows_a_range=2).orderBy("doc_id").collect()
    assert [r.doc_id for r in found] == ids
    prints = [r.fingerprint for r in found]
    likeness = lambda a, b: sum(a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)) / (len(a) // 4)
    for k, r in enumerate(found):
        assert r.near_next == pytest.approx(likeness(prints[k], prints[(k + 1) % 6])) and r.near_edited == pytest.approx(likeness(r.fingerprint, r.edited_fingerprint))
    assert prints[0] == prints[3]


def test_fingerprints_with_one_far_id(spark):
    rows = spark.range(400).selectExpr("if(id = 0, 9000000000000000000, id) as doc_id", "concat('text ', id) as text")
    assert fingerprint.compared_with_next(rows, rows_a_range=50).count() == 400


def test_neighbours_of_repeated_and_odd_rows(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (7, [2.0, 0.0]), (40, [1.0, 1.0, 1.0]), (41, [0.0, 2.0, 0.0])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id int, embedding array<float>")).collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(by[20]) == [(1, 7, 2.0), (1, 7, 2.0), (2, 20, 1.0), (2, 20, 1.0)] and by[40] == [(1, 41, 2.0)]


def test_trees_are_read_as_a_naive_walk_reads_them():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    model = quality.grow(x, (x[:, 0] > x[:, 1]).astype(float), trees=12)
    for row, found in zip(x[:80], model.score(x[:80]), strict=True):
        total = model.bias
        for feature, limit, leaf in zip(model.feature, model.limit, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            total += leaf[node - len(feature)]
        assert found == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.op10_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.95


def test_text_under_names_that_only_sound_like_furniture():
    page = (
        "<article><div class='text legal-analysis'><p>One of the texts here.</p></div><div class='story body comments-open'><p>Another text, and more.</p></div>"
        "<p>Let <math><mi>x</mi></math> be so.</p><div class='comment-list'><p>I like this a lot, really.</p></div><div class='ad-container'>Buy now.</div></article>"
    )
    assert html_text.main_text(page) == "One of the texts here.\nAnother text, and more.\nLet x be so."
    assert [html_text.said_by_name(n) for n in ("sidebar", "site-footer", "relatedPosts", "comment-list", "legal-analysis", "post-content", "mainContent", "grid")] == [-1, -1, -1, -1, 0, 1, 1, 0]


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a "' * 250_000 + ">", "".join(f"<div class=ad>Buy {k}</div><p>This is paragraph {k}, with words.</p>" for k in range(12_000)), "<div>" * 200_000 + "x", "<p>a " * 200_000, "<ul>" + "<li>x y" * 120_000])
def test_long_pages_take_no_longer_than_they_are_long(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 20


def test_classifier_learns_from_sure_blocks():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(4000), rng.uniform(0, 3, 4000), *(rng.integers(0, 2, 4000) for _ in range(4)), rng.uniform(0, 1, 4000)]).astype(float)
    y = (x[:, 2] > 0).astype(float)
    w = html_text.fitted(x, y)
    assert w[2] > html_text.START[2] + 1 and np.allclose(html_text.fitted(x[:0], y[:0]), html_text.START)


def listed_units(text: str, min_words: int = 8, min_line_words: int = 3):
    """(first unit, byte start, byte length, words) of every run that counts, read plainly."""
    import re

    units, lines, at = [], [], 0
    for number, line in enumerate(text.encode().split(b"\n")):
        own = []
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", line):
            own.append((at + m.start(), at + m.end(), m.group().lower()))
            if m.group()[-1:] in b".!?":
                units.append(own)
                lines.append(number)
                own = []
        if own:
            units.append(own)
            lines.append(number)
        at += len(line) + 1
    pairs = set()
    for k in range(len(units)):
        for end in range(k, len(units)):
            if sum(map(len, units[k : end + 1])) >= min_words:
                pairs.add((k, end))
                break
        for start in range(k, -1, -1):
            if sum(map(len, units[start : k + 1])) >= min_words:
                pairs.add((start, k))
                break
    for number in set(lines):
        own = [k for k, n in enumerate(lines) if n == number]
        if min_line_words <= sum(len(units[k]) for k in own) < min_words:
            pairs.add((own[0], own[-1]))
    for a, b in pairs:
        words = [w for u in units[a : b + 1] for w in u]
        yield a, words[0][0], words[-1][1] - words[0][0], tuple(w for *_, w in words)


def test_line_dedup_as_read_plainly(spark):
    rng = random.Random(12)
    sentences = [" ".join(rng.choices(["Alpha", "beta", "gamma", "Ünï", "delta"], k=rng.randint(1, 12))) + rng.choice([".", "!", "", "?"]) for _ in range(14)]
    texts = ["".join(rng.choice(sentences) + rng.choice([" ", "\n", "  ", "\n\n"]) for _ in range(rng.randint(0, 14))) for _ in range(40)]
    found = line_dedup.repeated_units(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    places = {}
    for k, text in enumerate(texts):
        for unit, start, length, words in listed_units(text):
            places.setdefault(words, []).append((k, unit, start, length))
    expected = []
    for words, where in places.items():
        first = min(where)[:2]
        expected += [(k, u, s, n, len(words), *first, len(where)) for k, u, s, n in where if (k, u) != first]
    columns = ("doc_id", "unit", "start", "length", "n_words", "first_doc_id", "first_unit", "occurrences")
    assert sorted(tuple(r[c] for c in columns) for r in found) == sorted(expected)


def test_very_long_texts(spark):
    from dossier.llm import substring_dedup

    rng = random.Random(2)
    long = " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(250_000))
    rows = spark.createDataFrame([(0, long), (1, long[:900_000]), (2, "x" * 1_500_000), (3, "short")], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(rows).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    assert fingerprint.compared_with_next(rows).count() == 4
    removed = {r.doc_id: (r.n_removed, r.n_bytes) for r in substring_dedup.remove_repeats(rows).collect()}
    assert removed == {0: (900_000, len(long)), 1: (900_000, 900_000), 2: (1_500_000, 1_500_000), 3: (0, 5)}
    assert line_dedup.repeated_units(rows).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.score_quality(rows, labels).count() == 4
    packed = packing.pack_documents(rows, tokenizer=queries.tokenizer_path()).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in packed} == {0, 1, 2, 3}


def test_rounds_of_components_have_plans_of_bounded_size(spark, monkeypatch):
    """Plans that name a side twice at every step double with each; the driver holds all of them."""
    from dossier.llm import common

    rng, leaves, cut = random.Random(5), [], common.cut

    def counted(df):
        leaves.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return cut(df)

    monkeypatch.setattr(common, "cut", counted)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [tuple(rng.sample(range(200, 300), 2)) for _ in range(80)]
    root = {k: k for e in edges for k in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = common.components(spark.createDataFrame(edges, "a int, b int")).collect()
    assert {r.node: r.root for r in found} == root and len(found) == len(root)
    assert max(leaves) <= 4


def test_a_group_in_many_buckets_is_proposed_by_a_forest(spark, monkeypatch):
    """What may be linked goes to the components as about one edge a member, not one for each bucket that holds it."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(120):
        words = list(base)
        for p in rng.sample(range(300), 6):
            words[p] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rows, counts, components = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), [], near_dedup.components

    def counted(edges):
        counts.append(edges.count())
        return components(edges)

    monkeypatch.setattr(near_dedup, "components", counted)
    near_dedup.near_duplicates(rows, width=4).collect()
    assert 0 < counts[1] <= 240, counts


def test_a_forest_connects_what_its_pairs_connect():
    import pyarrow as pa

    rng = random.Random(10)
    pairs = [(b"%d" % rng.randrange(30), b"%d" % rng.randrange(30)) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*pairs, strict=True)], ["a", "b"])
    classes = lambda found: {frozenset(c) for c in _classes(found)}
    for most in (1 << 18, 4):
        kept = [(r["a"], r["b"]) for out in near_dedup._forest(most)(iter([batch.slice(0, 150), batch.slice(150)])) for r in out.to_pylist()]
        assert classes(kept) == classes(pairs) and len(kept) <= 58


def _classes(pairs):
    found = []
    for a, b in pairs:
        both = [c for c in found if a in c or b in c]
        found = [c for c in found if c not in both] + [{a, b}.union(*both)]
    return found
