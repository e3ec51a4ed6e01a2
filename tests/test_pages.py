"""Words of two renderings in one row a page: matching blocks, and what the page queries deal out."""

import difflib
import random

import numpy as np
import pytest

from dossier import catalog
from dossier.operators import diffs

SF = "/root/testdata/sf0.001"


def _marks(found, n, side):
    return [any(t[side] <= k < t[side] + t[2] for t in found) for k in range(n)]


@pytest.mark.parametrize("most", [diffs.__dict__.get("MOST_CELLS"), 50])
def test_blocks_are_those_of_difflib(monkeypatch, most):
    rng = random.Random(1)
    monkeypatch.setattr(diffs, "MOST_CELLS", most)
    for _ in range(1000):
        letters = rng.choice([1, 2, 3, 6, 20])
        a = [rng.randrange(letters) for _ in range(rng.randint(0, 30))]
        b = [rng.randrange(letters) for _ in range(rng.randint(0, 30))] if rng.random() < 0.5 else [x if rng.random() < 0.8 else rng.randrange(letters) for x in a]
        expected = [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()]
        found = diffs.blocks(np.array(a, int), np.array(b, int))
        assert all(_marks(found, len(x), k) == _marks(expected, len(x), k) for k, x in enumerate((a, b)))


def test_matched_tokens_are_counted_where_the_pages_are(spark):
    assert "Exchange" not in catalog.QUERIES["q_matched_tokens"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_a_page_that_one_side_lacks(spark):
    words = lambda *rows: spark.createDataFrame([(1, p, k, w) for p, t in rows for k, w in enumerate(t.split())], "doc_id int, page int, pos int, text string")
    pages = diffs.paired(words((1, "one two"), (2, "three")), words((1, "one too"), (3, "four five")))
    assert {tuple(r) for r in diffs.tallied(pages).collect()} == {(1, 1, 1, 1), (1, 2, 0, None), (1, 3, None, 0)}


def shuffled(spark):
    """Rows that the session has written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages, total = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None), 0
    for k in range(stages.size()):
        total += stages.apply(k).shuffleWriteRecords()
    return total


@pytest.mark.parametrize("name", ["q_noise", "q_text_findings", "q_silent_lifts"])
def test_words_are_not_dealt_out(spark, name):
    n = sum(len(r.text.split()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r.text)
    before = shuffled(spark)
    catalog.QUERIES[name](spark, SF).collect()
    assert shuffled(spark) - before < n
