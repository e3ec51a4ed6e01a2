"""Incremental work: snapshots, quiet periods, content-keyed results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators.ordered import running


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, removed or modified between two snapshots (path, size, modified)."""
    a, b = before.alias("a"), after.alias("b")
    same = F.col("a.size").eqNullSafe(F.col("b.size")) & F.col("a.modified").eqNullSafe(F.col("b.modified"))
    change = F.when(F.col("a.path").isNull(), "added").when(F.col("b.path").isNull(), "removed").when(~same, "modified")
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), change.alias("change")).where("change is not null")


def settled(events: DataFrame, quiet: str = "2 seconds", by: str = "key") -> DataFrame:
    """One coalesced row for each burst of events (key, ts): a burst ends after a quiet period."""
    return events.groupBy(by, F.session_window("ts", quiet).alias("burst")).agg(F.count("*").alias("n_events")).select(by, F.col("burst.start").alias("first_ts"), "n_events")


def settled_stream(events: DataFrame, quiet: str = "2 seconds", late: str = "10 minutes", by: str = "key") -> DataFrame:
    """The same over a stream: events later than ``late`` are dropped, and a burst is emitted once it can't grow."""
    return settled(events.withWatermark("ts", late), quiet, by)


def watch(spark, root: str, build, checkpoint: str, schema: str = "path string, modificationTime timestamp, length bigint, content binary"):
    """Runs ``build(batch)`` on the files that are new below ``root``; a failing batch doesn't end the watch.

    The files of a failed batch are noted below ``checkpoint`` with the error and come again with the next batch, until one succeeds.
    """
    failed = f"{checkpoint}/failed"

    def again(session) -> DataFrame | None:
        try:
            notes = session.read.schema("path string, number bigint, error string").json(failed)
        except AnalysisException:
            return None
        paths = [r.path for r in notes.select("path").distinct().collect()]  # of failed batches alone
        return session.read.format("binaryFile").load(paths).select(*(c.split()[0] for c in schema.split(", "))) if paths else None

    def each(batch: DataFrame, number: int) -> None:
        old = again(batch.sparkSession)
        files = batch if old is None else batch.unionByName(old).dropDuplicates(["path"])
        try:
            build(files)
        except Exception as error:
            notes = files.select("path", F.lit(number).alias("number"), F.lit(str(error)[:500]).alias("error")).collect()
            batch.sparkSession.createDataFrame(notes, "path string, number bigint, error string").coalesce(1).write.mode("overwrite").json(failed)
        else:
            if old is not None:
                batch.sparkSession.createDataFrame([], "path string, number bigint, error string").write.mode("overwrite").json(failed)

    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def memo_key(*columns):
    """Digest of everything that a result depends on."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def missing(jobs: DataFrame, memo: DataFrame) -> DataFrame:
    """Jobs whose result is not kept."""
    return jobs.join(memo.select("key").distinct(), "key", "left_anti")


def pruned(entries: DataFrame, budget: int) -> DataFrame:
    """Entries (key, bytes, used) with ``kept``: newest first while their sum fits the budget. Entries that say no time are the oldest."""
    summed = running(entries, [F.desc_nulls_last("used"), F.col("key").asc()], F.col("bytes"))
    return summed.withColumn("kept", F.col("_total") <= budget).drop("_rank", "_total")
