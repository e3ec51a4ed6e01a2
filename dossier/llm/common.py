"""What the operators of this subpackage share: tables, lineage cuts, graph components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session, whose executors are this process, gets a temporary one where none is set; elsewhere that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="dossier-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder; lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of keys that are broadcast at most, each row counted with what a hash table adds to it.
MOST_BROADCAST, ROW_BYTES = 64 << 20, 48


def checked_broadcast(keys: DataFrame) -> DataFrame:
    """Written keys, with a broadcast hint only if their bytes allow it; beyond it the join shuffles.

    Fixed types count with 8 bytes, strings and byte strings with their lengths, lists with 64 bytes an entry.
    """
    keys = cut(keys)
    sizes = {"string": F.octet_length, "binary": F.octet_length, "array": lambda c: 64 * F.size(c), "struct": lambda c: F.lit(32)}
    own = [sizes.get(f.dataType.typeName(), lambda c: F.lit(8))(F.col(f.name)) for f in keys.schema]
    total = keys.agg(F.sum(sum((F.coalesce(c, F.lit(0)) for c in own), F.lit(ROW_BYTES)).cast("long"))).first()[0] or 0
    return F.broadcast(keys) if total <= MOST_BROADCAST else keys


def sampled(df: DataFrame, turn, most: int) -> DataFrame:
    """The ``most`` rows with the least ``turn``, a digest in hexadecimal, or all if they are fewer.

    Rows are counted by the first digits of their digests (a million counts at most) and only those that can be among the least are sorted, so no task gets a
    share of every other one's rows.
    """
    import math

    marked, n = df.withColumn("_turn", turn), df.count()
    if n > most:
        digits = min(5, max(1, math.ceil(math.log(4 * n / most, 16))))
        head = F.substring("_turn", 1, digits)
        counts, total, last = marked.groupBy(head.alias("p")).count().orderBy("p").collect(), 0, "f" * digits
        for row in counts:
            total += row["count"]
            if total >= most:
                last = row["p"]
                break
        marked = marked.where(head <= last)
    return marked.orderBy("_turn").limit(most).drop("_turn")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as (node, root): root is the least node of its component.

    Alternating large-star and small-star rounds: every star is a grouped minimum and a join, the
    edge count never grows, and paths shorten geometrically; rounds go on until one changes nothing. Nodes without edges are not listed.
    Each star is cut and its rows are turned by ``inline``, not by a union: a side that is named twice is planned twice, and plans that
    double at every step fill the driver's memory.
    """

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    def each(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
        return rows.select(F.inline(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ends))))

    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(edges)
    while seen[0]:
        tasks = seen[0] // 50_000 + 8  # few edges don't need a file for each of many partitions

        def lows(both: DataFrame, tasks=tasks) -> DataFrame:
            return both.join(both.groupBy("a").agg(F.min("b").alias("m")), "a").coalesce(tasks)

        both = each(edges.coalesce(tasks), ("a", "b"), ("b", "a"))
        large = cut(lows(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct().coalesce(tasks))
        edges = cut(each(lows(large), ("b", "m"), ("a", "m")).where("a <> b").distinct().coalesce(tasks))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def streams(batches, keys: list[str], most: int = 1 << 16):
    """Regroups sorted Arrow batches: yields record batches that hold whole runs of equal keys.

    Rows of one key may span batches; a key's rows always come together, in order.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def settled(t):
        """Rows before the last key's first one."""
        last = None
        for k in keys:
            column = t.column(k)
            same = pc.fill_null(pc.equal(column, column[t.num_rows - 1]), False) if column[t.num_rows - 1].is_valid else pc.is_null(column)
            last = same if last is None else pc.and_(last, same)
        return pc.index(last, True).as_py()

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        if held.num_rows < most:
            continue
        n = settled(held)
        if n:
            yield held.slice(0, n).combine_chunks().to_batches()[0]
            held = held.slice(n)
    if held is not None and held.num_rows:
        yield held.combine_chunks().to_batches()[0]
