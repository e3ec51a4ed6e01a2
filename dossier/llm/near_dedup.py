"""Near-duplicate classes by circulant MinHash.

One permutation places a shingle on a ring, a second one ranks the ring; coordinate ``k`` of a
signature is the least rank over a document's shingles after the ring has been shifted by ``k``.
A shingle's ranks under all shifts lie side by side, so one gather of ``k`` neighbours per shingle
and a column minimum give the whole signature. Signatures are banded; bands only propose pairs,
every link is confirmed on the full shingle sets.

Nodes of the link graph are distinct shingle sets, so a group of copies of any size is one node.
A bucket proposes a star around its most typical member first. Members that stay outside the
bucket's main class are then compared with the whole bucket in blocks of sketches. What may still be linked across
classes forms clumps, whose full sets are compared in blocks, so no link between two classes is passed over;
pairs within one class need no test, as they can't change a class. Pairs are never listed, only links are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import flat
from dossier.llm.common import components, cut, streams

RING = 1 << 20
#: Members of a bucket that are compared in one block.
BLOCK = 2048
#: Full sets of a clump that are compared in one block.
SET_BLOCK = 256


def ring(coordinates: int, seed: int = 7) -> np.ndarray:
    """Ranks around the ring, continued by its own start so that every shift is a plain slice."""
    ranks = np.random.default_rng(seed).permutation(RING).astype(np.uint32)
    return np.concatenate((ranks, ranks[:coordinates]))


def signatures(value: np.ndarray, at: np.ndarray, ranks: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of each row's shingles: (rows, coordinates)."""
    shifted = np.lib.stride_tricks.sliding_window_view(ranks, coordinates)
    place = (flat.mix(value ^ np.uint64(0x51ED270B9F0C4C35)) >> np.uint64(44)).astype(np.int64)
    out = np.full((len(at) - 1, coordinates), np.iinfo(np.uint32).max, np.uint32)
    for i in range(len(at) - 1):
        for c in range(at[i], at[i + 1], 2048):
            np.minimum(out[i], shifted[place[c : min(at[i + 1], c + 2048)]].min(axis=0), out=out[i])
    return out


def set_name(values: np.ndarray) -> bytes:
    import hashlib

    return hashlib.md5(values.tobytes()).digest()


def _sign(width: int, bands: int, rows: int):
    """mapInArrow: (id, text) to (id, n, set, bands, sketch)."""

    def run(batches):
        import pyarrow as pa

        ranks = ring(bands * rows)
        salt = flat.mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            buf, off = flat.columns(batch, "text")
            for i, j in flat.slices(off):
                value, at = flat.shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                sig = signatures(value, at, ranks, bands * rows)
                with np.errstate(over="ignore"):
                    keys = flat.mix((flat.mix(sig.reshape(j - i, bands, rows).astype(np.uint64)) * salt).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                sketch = flat.mix(sig.astype(np.uint64)).astype(np.uint8)
                n = np.diff(at)
                empty = n == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(n, pa.int64()),
                        pa.array([None if e else set_name(value[at[r] : at[r + 1]]) for r, e in enumerate(empty)], pa.binary()),
                        pa.array([None if e else keys[r].view(np.int64) for r, e in enumerate(empty)], pa.list_(pa.int64())),
                        pa.array([None if e else sketch[r].tobytes() for r, e in enumerate(empty)], pa.binary()),
                    ],
                    ["id", "n", "set", "bands", "sketch"],
                )

    return flat.released(run)


def _full_sets(width: int):
    """mapInArrow: (text) to (set, shingles as little-endian 64-bit values)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            buf, off = flat.columns(batch, "text")
            for i, j in flat.slices(off):
                value, at = flat.shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                rows = [value[at[r] : at[r + 1]] for r in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array([set_name(v) for v in rows], pa.binary()), pa.array([v.tobytes() for v in rows], pa.binary())], ["set", "shingles"])

    return flat.released(run)


def _confirm(percent: int):
    """mapInArrow: pairs with both full sets to the pairs that are links."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    return flat.released(run)


def _forest(most: int = 1 << 18):
    """mapInArrow: pairs (a, b) without those whose ends a task's earlier pairs connect already.

    ``most`` names are remembered; after that the forest begins anew, which costs pairs but loses no connection.
    """

    def run(batches):
        import pyarrow as pa

        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[x]
            return x

        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if (p := root(a)) != (q := root(b)):
                    keep[i], parent[p] = True, q
            if len(parent) > most:
                parent.clear()
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns], ["a", "b"])

    return flat.released(run)


def _groups(batch, keys):
    """(first, end) of each run of equal keys."""
    cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
    edge = np.zeros(batch.num_rows, bool)
    edge[0] = True
    for c in cols:
        edge[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(edge)
    return zip(start, np.append(start[1:], batch.num_rows), strict=True)


def _sketches(batch, name: str = "sketch") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def _stars(least: float):
    """mapInArrow over buckets in order: stars around typical members, until none is left."""

    def run(batches):
        import pyarrow as pa

        for batch in streams(batches, ["bucket", "block"], most=1 << 14):
            names, all_rows = batch.column("set").to_pylist(), _sketches(batch)
            a, b = [], []
            for lo, hi in _groups(batch, ["bucket", "block"]):
                rest = np.arange(lo, hi)
                while len(rest) > 1:
                    rows = all_rows[rest]
                    if len(rest) <= 48:
                        hub = int((rows[:, None, :] == rows[None, :, :]).mean(axis=2).sum(axis=1).argmax())
                    else:
                        usual = np.array([np.bincount(c, minlength=256).argmax() for c in rows.T], np.uint8)
                        hub = int((rows == usual).sum(axis=1).argmax())
                    near = (rows == rows[hub]).mean(axis=1) >= least
                    near[hub] = False
                    a += [names[rest[hub]]] * int(near.sum())
                    b += [names[k] for k in rest[near]]
                    near[hub] = True
                    rest = rest[~near]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return flat.released(run)


def _across(least: float):
    """mapInArrow over (bucket, block, face): a block of members against a block of probes, where the classes differ.

    Emits the edges of a spanning forest of the pairs that may be links, not the pairs.
    """

    def run(batches):
        import pyarrow as pa

        for batch in streams(batches, ["bucket", "block", "face"], most=1 << 14):
            names, kinds = batch.column("set").to_pylist(), batch.column("root").to_pylist()
            code = {k: i for i, k in enumerate(dict.fromkeys(kinds))}
            root = np.array([code[k] for k in kinds])
            probe, rows = batch.column("probe").to_numpy(zero_copy_only=False).astype(bool), _sketches(batch)
            a, b = [], []
            for lo, hi in _groups(batch, ["bucket", "block", "face"]):
                own = np.arange(lo, hi)
                member = own[~probe[lo:hi]]
                tree = np.arange(hi - lo)
                for p in own[probe[lo:hi]]:
                    hit = member[root[member] != root[p]]
                    hit = hit[(rows[hit] == rows[p]).mean(axis=1) >= least]
                    if len(hit):
                        joined = np.unique(tree[np.append(hit, p) - lo])
                        tree[np.isin(tree, joined)] = joined[0]
                for k in np.flatnonzero(tree != np.arange(hi - lo)):
                    a.append(names[lo + k])
                    b.append(names[lo + tree[k]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return flat.released(run)


def _in_blocks(percent: int):
    """mapInArrow over (clump, block, face): a block of probes' full sets against a block of members', where the classes differ."""

    def run(batches):
        import pyarrow as pa

        for batch in streams(batches, ["clump", "block", "face"], most=256):
            names, kinds = batch.column("set").to_pylist(), batch.column("root").to_pylist()
            code = {k: i for i, k in enumerate(dict.fromkeys(kinds))}
            root, probe = np.array([code[k] for k in kinds]), batch.column("probe").to_numpy(zero_copy_only=False).astype(bool)
            column = batch.column("shingles")
            sets = [np.frombuffer(column[k].as_buffer(), np.uint64) for k in range(batch.num_rows)]
            size = np.array([len(x) for x in sets])
            a, b = [], []
            for lo, hi in _groups(batch, ["clump", "block", "face"]):
                own = np.arange(lo, hi)
                member, probes = own[~probe[lo:hi]], own[probe[lo:hi]]
                if not len(member) or not len(probes):
                    continue
                value, owner = np.concatenate([sets[k] for k in member]), np.repeat(np.arange(len(member)), size[member])
                order = np.argsort(value, kind="stable")
                value, owner = value[order], owner[order]
                for p in probes:
                    first, last = np.searchsorted(value, sets[p], "left"), np.searchsorted(value, sets[p], "right")
                    run_ = last - first
                    at = np.repeat(first - (np.cumsum(run_) - run_), run_) + np.arange(run_.sum())
                    both = np.bincount(owner[at], minlength=len(member))
                    linked = (100 * both >= percent * (size[member] + size[p] - both)) & (root[member] != root[p])
                    a += [names[p]] * int(linked.sum())
                    b += [names[k] for k in member[linked]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return flat.released(run)


def _facing(placed: DataFrame, most: int) -> DataFrame:
    """Sets (set, root, main, m, most) of groups of ``m`` with a main class of ``most``: members and probes of every pair of blocks (block, face)."""
    blocks, faces = F.ceil(F.col("m") / most).cast("int"), F.greatest(F.lit(1), F.ceil((F.col("m") - F.col("most")) / most).cast("int"))
    place = lambda parts: F.pmod(F.xxhash64("set"), parts).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    members = placed.withColumn("probe", F.lit(False)).withColumn("block", place(blocks)).withColumn("face", each(faces))
    probes = placed.where("root <> main").withColumn("probe", F.lit(True)).withColumn("face", place(faces)).withColumn("block", each(blocks))
    return members.unionByName(probes)


def _clump_links(clumps: DataFrame, roots: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links between classes within clumps of sets that may be linked.

    All sets of a clump are dealt over blocks of members, those outside its largest class over blocks of probes, too; each
    block of the one kind meets each of the other, so a task holds two blocks, whatever the clump.
    """
    placed = clumps.select(F.col("node").alias("set"), F.col("root").alias("clump")).join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    tally = placed.groupBy("clump", "root").agg(F.count("*").alias("k"))
    main = tally.groupBy("clump").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("m"), F.max("k").alias("most"))
    rows = _facing(cut(placed.join(main, "clump")), SET_BLOCK).join(full, "set")
    rows = rows.select("clump", "block", "face", "set", "root", "probe", "shingles").repartition("clump", "block", "face").sortWithinPartitions("clump", "block", "face")
    return cut(rows.mapInArrow(_in_blocks(percent), PAIR).distinct())


PAIR = "a binary, b binary"


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 45, rows: int = 6) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct
    ``width``-word shingles; ``component_id`` is the least id reachable over links. A text that is null, empty or
    without words has no shingles and is linked with nothing. Rows that repeat an id share its class;
    a null id is never the least one, and a class of null ids only has a null component and is kept.
    Other columns of ``docs`` are not read. An empty table gives an empty result.

    At ``percent`` = 80 a linked pair of texts shares none of the 45 bands of 6 with a chance of 1e-6; the
    sketch comparison before the exact one passes pairs down to 5.5 standard errors below the limit.
    """
    flat.ship()
    limit = percent / 100
    least = limit - 5.5 * (limit * (1 - limit) / (bands * rows)) ** 0.5
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    signed = cut(texts.mapInArrow(_sign(width, bands, rows), f"id {id_type}, n bigint, set binary, bands array<bigint>, sketch binary"))
    nodes = cut(signed.where("set is not null").groupBy("set").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))

    # Buckets are found on 64-bit node numbers; two nodes with one number are only proposed together.
    entries = nodes.select(F.xxhash64("set").alias("node"), F.explode("bands").alias("bucket"))
    same = entries.groupBy("bucket").agg(F.count("*").alias("m"), F.bit_xor("node").alias("sum"), F.min("node").alias("lo"))
    buckets = same.where("m > 1").groupBy("m", "lo", "sum").agg(F.min("bucket").alias("bucket")).select("bucket", "m")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    members = entries.join(buckets, "bucket").join(nodes.select(F.xxhash64("set").alias("node"), "set"), "node")
    members = cut(members.select("bucket", "set", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")))

    def listed(df: DataFrame, keys: list[str], *extra: str) -> DataFrame:
        return df.join(nodes.select("set", "sketch"), "set").select(*keys, "set", "sketch", *extra).repartition(*keys).sortWithinPartitions(*keys)

    wanted = members.select("set").distinct().join(nodes.select("set", "id"), "set").select("id")
    full = texts.join(wanted.distinct(), "id", "left_semi") if id_type != "void" else texts.limit(0)
    full = full.unionByName(texts.where("id is null")).select("text").mapInArrow(_full_sets(width), "set binary, shingles binary")
    full = cut(full.join(members.select("set").distinct(), "set", "left_semi").dropDuplicates(["set"]))

    def links(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        both = ends.join(full.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a").join(full.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b")
        return cut(both.select("a", "b", "x", "y").mapInArrow(_confirm(percent), PAIR))

    first = links(listed(members, ["bucket", "block"]).mapInArrow(_stars(least), PAIR))
    roots = cut(components(first))

    placed = members.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    tally = placed.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    mixed = tally.groupBy("bucket").agg(F.count("*").alias("classes"), F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("m"), F.max("k").alias("most")).where("classes > 1").drop("classes")
    open_ = cut(placed.select("bucket", "set", "root").join(mixed, "bucket"))
    # A group that many buckets hold comes with a forest from each; sorted by name they mostly share their roots, and a member's own edges meet in one task.
    facing = listed(_facing(open_, BLOCK), ["bucket", "block", "face"], "root", "probe").sortWithinPartitions("bucket", "block", "face", "set").mapInArrow(_across(least), PAIR)
    facing = facing.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).repartition("a").mapInArrow(_forest(), PAIR)
    clumps = cut(components(facing))
    if not clumps.isEmpty():
        second = _clump_links(clumps, roots, full, percent)
        roots = components(first.unionByName(second)) if not second.isEmpty() else roots

    classes = nodes.select("set", "id").join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    least_id = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    by_set = classes.join(least_id, "root").select("set", "component_id")
    out = signed.select("id", "n", "set").join(by_set, "set", "left")
    component = F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.col("id").isNull() & component.isNull()).alias("kept"))
