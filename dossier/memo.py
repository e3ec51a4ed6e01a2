"""Kept results by content: a table of entries in a folder, which jobs are looked up in and which is pruned to a budget."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import jobs
from dossier.operators.lineage import written
from dossier.streaming.watch import pruned

SCHEMA = "key string, own_key string, result string, sha string, bytes bigint, used timestamp, shard string"


class Memo:
    """Results under their keys, in files by the key's first digits. An entry is added, never changed; the newest of a key counts."""

    def __init__(self, spark: SparkSession, folder: str, budget: int = 5 << 30):
        self.spark, self.folder, self.budget = spark, folder, budget

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.folder)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def get(self, work: DataFrame) -> DataFrame:
        """Jobs (key, ...) with result, null where nothing sound is kept."""
        newest = self.entries().groupBy("key").agg(F.max_by(F.struct("own_key", "result", "sha"), "used").alias("e")).select("key", "e.*")
        return jobs.restored(work, newest)

    def put(self, results: DataFrame) -> None:
        """Keeps results (key, result, refusal) that are not refused."""
        kept = results.where("refusal is null").select("key", F.col("key").alias("own_key"), "result", F.sha2("result", 256).alias("sha"), F.octet_length("result").cast("bigint").alias("bytes"), F.current_timestamp().alias("used"), F.substring("key", 1, 2).alias("shard"))
        kept.write.mode("append").partitionBy("shard").parquet(self.folder)

    def stats(self) -> DataFrame:
        return jobs.memo_stats(self.entries())

    def prune(self) -> DataFrame:
        """Entries with ``kept``, newest first within the budget; the table is written anew with those."""
        marked = pruned(self.entries().groupBy("key").agg(F.max_by(F.struct("own_key", "result", "sha", "bytes", "used", "shard"), "used").alias("e")).select("key", "e.*"), self.budget)
        marked = written(marked)
        fresh = f"{self.folder}.pruned"
        marked.where("kept").drop("kept").write.mode("overwrite").partitionBy("shard").parquet(fresh)
        self._swap(fresh)
        return marked

    def clear(self) -> None:
        self._files().delete(self._path(self.folder), True)

    def _path(self, folder: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)

    def _files(self):
        return self._path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _swap(self, fresh: str) -> None:
        self.clear()
        self._files().rename(self._path(fresh), self._path(self.folder))
