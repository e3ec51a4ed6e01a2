"""Nearest neighbours by additive quantisation.

A vector is coded as a sum of one entry from each of several codebooks, all of full dimension. Codebooks are
residual k-means of a bounded sample; codes are found by beam search. Beside the codes stands the quotient of the vector's norm and that of its sum: the
sums are shorter than the vectors, the more so the worse they fit. A query is scored against codes with one lookup table and
that quotient; a shortlist is scored again on the original vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm import flat
from dossier.llm.common import cut, sampled, streams

#: Vectors that codebooks are fitted on at most, chosen by digest of their ids. Every vector is indexed.
SAMPLE = 16_384
BOOKS, ENTRIES, BEAM = 32, 256, 4
QUERY_BLOCK, ROW_BLOCK = 1024, 32_768


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 6) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        of = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        count = np.bincount(of, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """(rows, books) codes by beam search: the ``beam`` best partial sums are carried from book to book."""
    n, (m, k, d) = len(x), books.shape
    out = np.empty((n, m), np.uint8)
    for lo in range(0, n, 1024):
        part = x[lo : lo + 1024]
        rest, codes = part[:, None, :], np.zeros((len(part), 1, 0), np.uint8)
        for book in books:
            size = (rest**2).sum(axis=2)[:, :, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(len(part), -1, k) + (book**2).sum(axis=1)
            size = size.reshape(len(part), -1)
            width = min(beam, size.shape[1])
            best = np.argpartition(size, width - 1, axis=1)[:, :width]
            best = np.take_along_axis(best, np.take_along_axis(size, best, axis=1).argsort(axis=1, kind="stable"), axis=1)
            old, entry = best // k, best % k
            rest = np.take_along_axis(rest, old[:, :, None], axis=1) - book[entry]
            codes = np.concatenate((np.take_along_axis(codes, old[:, :, None], axis=1), entry[:, :, None].astype(np.uint8)), axis=2)
        out[lo : lo + 1024] = codes[:, 0]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum((book[codes[:, m]] for m, book in enumerate(books)), np.zeros((len(codes), books.shape[2]), np.float32))


def fit(x: np.ndarray, m: int = BOOKS, k: int = ENTRIES, seed: int = 3) -> np.ndarray:
    """(m, k, d) codebooks, each fitted on what those before it leave."""
    rng, rest, books = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(m):
        book = _kmeans(rest, k, rng)
        rest = rest - book[(rest @ book.T - (book**2).sum(axis=1) / 2).argmax(axis=1)]
        books.append(book)
    return np.stack(books)


def _vectors(batch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1)


def _encode_rows(books: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch, "vector")
                codes = encode(x, books)
                sums = np.sqrt((decode(codes, books) ** 2).sum(axis=1))
                stretch = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) / np.maximum(sums, 1e-30)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(stretch, pa.float32())], ["row", "codes", "stretch"])

    return flat.released(run)


def _search(books: np.ndarray, shortlist: int):
    """mapInArrow over (query block, row block): each query's best rows by lookup tables, ties to smaller rows."""

    def run(batches):
        import pyarrow as pa

        for batch in streams(batches, ["q", "r"], most=4 * ROW_BLOCK):
            q, r = batch.column("q").to_numpy(), batch.column("r").to_numpy()
            edge = [0, *(np.flatnonzero((np.diff(q) != 0) | (np.diff(r) != 0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edge, edge[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                asks = part.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                if not asks.any() or asks.all():
                    continue
                ids = np.stack([part.column("row").field(k).to_numpy() for k in range(2)], axis=1)
                rows = np.flatnonzero(~asks)
                codes = np.frombuffer(b"".join(part.column("codes").take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1).T.astype(np.intp)
                stretch = part.column("stretch").to_numpy(zero_copy_only=False)[rows].astype(np.float32)
                row_id = ids[rows]
                query, hit, score = [], [], []
                for at, vector in zip(np.flatnonzero(asks), part.column("vector").take(pa.array(np.flatnonzero(asks))).to_pylist(), strict=True):
                    table = books @ np.array(vector, np.float32)
                    total = np.zeros(len(rows), np.float32)
                    for m, own in enumerate(codes):
                        total += table[m][own]
                    total *= stretch
                    if len(total) > shortlist + 1:
                        near = np.flatnonzero(total >= np.partition(total, len(total) - shortlist - 1)[len(total) - shortlist - 1])
                    else:
                        near = np.arange(len(total))
                    near = near[(-total[near]).argsort(kind="stable")]
                    near = near[(row_id[near] != ids[at]).any(axis=1)][:shortlist]
                    query.append(np.repeat(ids[at][None], len(near), axis=0))
                    hit.append(row_id[near])
                    score.append(total[near])
                pair = lambda x: pa.StructArray.from_arrays([pa.array(np.concatenate(x)[:, k]) for k in range(2)], ["id", "n"])
                yield pa.RecordBatch.from_arrays([pair(query), pair(hit), pa.array(np.concatenate(score))], ["query", "row", "about"])

    return flat.released(run)


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, shortlist: int = 250, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the ``k`` other rows of largest inner product.

    Scores are inner products of the original vectors in double precision, ranks count from 1, ties go to smaller ids; with fewer
    than ``k`` candidates all are returned. Vectors that are null, zero, or hold null or non-finite components take no part, nor
    do rows without an id. Rows that repeat an id are rows of their own, each a candidate of the others. Only vectors of one length have an
    inner product, so each length is searched by itself. Ids are whole numbers of any type. Other columns are not read; an empty table gives
    an empty result. The ``shortlist`` best rows by codes are scored exactly.
    """
    flat.ship()
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull() & v.isNotNull())
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    nth = F.row_number().over(Window.partitionBy("id").orderBy("vector")).cast("bigint")
    rows = cut(rows.where(sound).withColumn("n", nth).select(F.struct("id", "n").alias("row"), "vector"))
    lengths = sorted(r["d"] for r in rows.select(F.size("vector").alias("d")).distinct().collect())
    found = [_nearest_of(rows.where(F.size("vector") == d) if len(lengths) > 1 else rows, every, k, shortlist, sample) for d in lengths]
    if not found:
        return rows.select(F.col("row.id").alias("query_id"), F.lit(0).alias("rank"), F.col("row.id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _nearest_of(rows: DataFrame, every: int, k: int, shortlist: int, sample: int) -> DataFrame:
    """The search among rows (row, vector) of one length."""
    v = F.col("vector")
    fitted = sampled(rows, F.md5(F.to_json("row")), sample).select("vector").collect()
    books = fit(np.array([r["vector"] for r in fitted], np.float32))
    n = rows.count()
    row_blocks, query_blocks = -(-n // ROW_BLOCK), -(-(n // every + 1) // QUERY_BLOCK)
    is_query = F.pmod(F.col("row.id"), F.lit(every)) == 0
    block = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    key = "struct<id: bigint, n: bigint>"
    coded = cut(rows.mapInArrow(_encode_rows(books), f"row {key}, codes binary, stretch float"))
    told = coded.select("row", F.lit(False).alias("asks"), "codes", "stretch", F.lit(None).cast("array<float>").alias("vector"), each(query_blocks).alias("q"), block(row_blocks).alias("r"))
    asked = rows.where(is_query).select("row", F.lit(True).alias("asks"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("stretch"), v.cast("array<float>").alias("vector"), block(query_blocks).alias("q"), each(row_blocks).alias("r"))
    met = told.unionByName(asked).repartition("q", "r").sortWithinPartitions("q", "r", "row")
    found = met.mapInArrow(_search(books, shortlist), f"query {key}, row {key}, about float")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("about"), "row"))
    found = found.withColumn("place", best).where(F.col("place") <= shortlist).select("query", "row")
    pairs = found.join(rows, "row").join(rows.select(F.col("row").alias("query"), v.alias("asked")), "query")
    product = F.aggregate(F.zip_with("asked", "vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda total, x: total + x)
    ranked = pairs.select("query", "row", product.alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "row")))
    return ranked.where(F.col("rank") <= k).select(F.col("query.id").alias("query_id"), "rank", F.col("row.id").alias("vec_id"), "score")
