"""Sharding by fixed virtual slots.

A record hashes into one of 4096 slots for good. What changes is the map from slots to shards: it is
drawn from the bytes that each slot holds, kept under a version number, and edited, slot by slot, when shards
are added or drift apart. Only DataFrame functions touch the records; the map has a row for each slot,
whatever the data, and is planned on the driver.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import cut

SLOTS = 4096


@dataclass(frozen=True)
class ShardMap:
    """Which shard each slot belongs to, under a version that grows with every edit."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def balanced(cls, sizes: dict[int, int], shards: int, slots: int = SLOTS) -> ShardMap:
        """Largest slot first, each to the shard with the fewest bytes so far (ties: the lower shard)."""
        heap, shard_of = [(0, s) for s in range(shards)], [0] * slots
        for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
            total, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            heapq.heappush(heap, (total + sizes.get(slot, 0), shard))
        return cls(1, shards, tuple(shard_of))

    def grown(self, sizes: dict[int, int]) -> ShardMap:
        """The next version, with one more shard. Slots move into the new shard only."""
        return self._moved(sizes, self.shards + 1)

    def rebalanced(self, sizes: dict[int, int]) -> ShardMap:
        """The next version with the same shards: slots leave shards above the mean for the smallest one."""
        return self._moved(sizes, self.shards)

    def _moved(self, sizes: dict[int, int], shards: int) -> ShardMap:
        shard_of, totals = list(self.shard_of), [0] * shards
        for slot, shard in enumerate(shard_of):
            totals[shard] += sizes.get(slot, 0)
        mean = sum(totals) / shards
        for slot in sorted(range(len(shard_of)), key=lambda s: (-sizes.get(s, 0), s)):
            size, old = sizes.get(slot, 0), shard_of[slot]
            new = shards - 1 if shards > self.shards else min(range(shards), key=lambda s: (totals[s], s))
            if size and new != old and totals[old] > mean and totals[new] + size <= max(mean, totals[old] - size):
                totals[old] -= size
                totals[new] += size
                shard_of[slot] = new
        return ShardMap(self.version + 1, shards, tuple(shard_of))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as a table (version, shards, slot, shard), to be kept beside the shards."""
        listed = ",".join(map(str, self.shard_of))
        return spark.sql(f"select {self.version} as version, {self.shards} as shards, pos as slot, cast(col as int) as shard from (select posexplode(split('{listed}', ',')))")

    def save(self, spark: SparkSession, folder: str) -> None:
        """Adds this version to the maps kept in a folder; versions are never changed."""
        self.frame(spark).coalesce(1).write.mode("append").parquet(folder)

    @classmethod
    def latest(cls, spark: SparkSession, folder: str) -> ShardMap | None:
        """The latest version that a folder keeps, if any."""
        try:
            return cls.read(spark.read.parquet(folder))
        except AnalysisException:
            return None

    @classmethod
    def read(cls, frame: DataFrame, version: int | None = None) -> ShardMap:
        """A stored map: the given version, or the latest."""
        version = version if version is not None else frame.agg(F.max("version")).first()[0]
        rows = frame.where(F.col("version") == version).orderBy("slot").collect()
        return cls(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def looked_up(values, slot):
    """``values[slot]``, as one constant array in the plan."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ","), slot + 1)


def slotted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each record."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    records = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return records.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def shard_documents(docs: DataFrame, *, shards: int = 8, maps: str | None = None, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, map_version for each row of ``docs``.

    size is the text's UTF-8 bytes plus 1 (null: 1; its checksum is that of the empty text). The law is
    ``bytes``: shard sizes are as near to equal as slots allow. ``maps`` is a folder of kept maps: its latest one is applied, and where it has none the first one is
    drawn and kept there. slot is the row's place in its shard, gapless from 0.
    grown_shard is null under this law. Copies of one text (groups) are kept together only if they share an id: whole groups could not be put into near equal shards. Repeated rows each get a place of their own; copies of one text under
    different ids spread over shards; a null id counts as one more id. Other columns are not read.
    """
    records = cut(slotted(docs, id_col=id_col, text_col=text_col, slots=slots))
    held = {r["vslot"]: (r["bytes"], r["rows"]) for r in records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    spark, sizes = docs.sparkSession, {s: b for s, (b, _) in held.items()}
    shard_map = ShardMap.latest(spark, maps) if maps else None
    if shard_map is None:
        shard_map = ShardMap.balanced(sizes, shards, slots)
        if maps:
            shard_map.save(spark, maps)
            shard_map = ShardMap.latest(spark, maps)
    first, filled = [0] * slots, [0] * shard_map.shards
    for slot, shard in enumerate(shard_map.shard_of):
        first[slot] = filled[shard]
        filled[shard] += held.get(slot, (0, 0))[1]
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return records.withColumn("place", place).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        looked_up(shard_map.shard_of, F.col("vslot")).cast("int").alias("shard"),
        (looked_up(first, F.col("vslot")).cast("long") + F.col("place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.lit(shard_map.version).alias("map_version"),
    )
