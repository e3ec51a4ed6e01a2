"""Mixing sources to target weights by weighted fair queueing.

Each source sends its documents in a shuffled order, over and over. A document's virtual finish time is its
source's words sent so far, divided by the source's target. All sources reach their targets at virtual
time 1, so the mix in order of finish times, cut at the total budget, is what each source has sent by then.

Shuffled order is the order of a digest; its first digits split a source into 4096 runs. Word sums of
runs give every run its start, and only rows of one run are summed in order, so no source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import cut

WEIGHTS = (5, 2, 1)
#: A document is sent so many times at most; a source's target is so many times its size at most.
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def shares(sources: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(no_source, name, source_size) to the same with weight and target.

    The sum of all sizes is shared by weight. A target above ``repeats`` times its source's size stops there and the
    excess goes to the others by weight. With sources in order of ``repeats * size / weight``, those that stop come
    first; the level of the others is what is left over their weights.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy("no_source", "name")))
    weighted = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    order = Window.orderBy(repeats * F.col("source_size") / F.col("weight"), "rank")
    before, onward, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    levels = weighted.withColumn("level", left / F.sum("weight").over(onward)).withColumn("rank_by", F.row_number().over(order))
    open_ = F.min(F.when(repeats * F.col("source_size") / F.col("weight") >= F.col("level"), F.col("rank_by"))).over(everything)
    levels = levels.withColumn("first_open", open_)
    level = F.max(F.when(F.col("rank_by") == F.col("first_open"), F.col("level"))).over(everything)
    target = F.when(F.col("rank_by") < F.col("first_open"), (repeats * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("level"))
    return levels.withColumn("level", level).withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(target)).select("no_source", "name", "source_size", "weight", "target")


def _size(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _queued_counts(rows: DataFrame, weights, repeats: int, seed: str) -> DataFrame:
    """(doc_id, source, size, others) to the same with source_size, target and start.

    start: the words of its source that are sent before the row.
    """
    turn = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    rows = rows.withColumns({"turn": turn, "no_source": F.col("source").isNull(), "name": F.coalesce(F.col("source"), F.lit(""))}).withColumn("run", F.substring("turn", 1, 3))
    key = ["no_source", "name"]
    runs = rows.groupBy(*key, "run").agg(F.sum("size").alias("run_size"))
    runs = runs.withColumn("run_start", F.sum("run_size").over(Window.partitionBy(*key).orderBy("run")) - F.col("run_size"))
    sources = shares(runs.groupBy(*key).agg(F.sum("run_size").alias("source_size")), weights, repeats)
    runs = runs.join(sources, key).select(*key, "run", "run_start", "source_size", "target")
    inner = Window.partitionBy(*key, "run").orderBy("turn", "size").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(runs, [*key, "run"]).withColumn("start", F.col("run_start") + F.coalesce(F.sum("size").over(inner), F.lit(0))).drop("run_start")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, finish for each row of ``docs``, in order of finish times.

    taken counts the words that the mix takes, each turn of the document included; the document in service when
    the budget is spent is taken in part. finish is the virtual time at which the first turn ends. Sources rank by
    code point, null last. A null or empty text has size 0 and takes 0; repeated rows are queued one
    after the other. Reruns agree: the order depends on the seed, the id and the size alone.
    """
    counted = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _size(text_col).alias("size")))  # words are counted once
    rows = _queued_counts(counted, weights, repeats, seed)
    budget = F.round("target").cast("long")
    taken = sum((F.greatest(F.lit(0), F.least(budget - (F.col("start") + n * F.col("source_size")), F.col("size"))) for n in range(repeats)), F.lit(0))
    finish = F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target"))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), finish.alias("finish")).orderBy(F.col("finish").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """The mix itself: whole rows of ``docs``, each as often as it is taken.

    A turn counts if at least half of the document fits into its source's target, so the source's words differ from
    the target by half a document at most. Rows without words cost nothing and stay once.
    """
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    rows = _queued_counts(docs.select(whole, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _size(text_col).alias("size")), weights, repeats, seed)
    turns = sum((F.when(2 * (F.col("start") + n * F.col("source_size")) + F.col("size") <= 2 * F.col("target"), 1).otherwise(0) for n in range(repeats)), F.lit(0))
    turns = F.when(F.col("size") == 0, 1).otherwise(turns)
    return rows.withColumn("turn", F.explode(F.when(turns > 0, F.sequence(F.lit(1), turns)).otherwise(F.array().cast("array<int>")))).select("row.*")
