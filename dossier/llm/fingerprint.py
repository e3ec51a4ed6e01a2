"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its words, lower-cased, each with the bytes it covers as weight. For every coordinate a word draws two
gamma variates and one uniform from its own hash; the word whose sample is least, with the quantised level of its
weight, is the coordinate. Two documents agree on a coordinate with the generalised Jaccard similarity of their weights as chance.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm import flat

COORDINATES = 64
#: Longer words count as pieces of this many bytes, so that a text without white space has parts, too.
PIECE = 16
#: Bytes of texts that are sampled at once; each distinct term among them holds three numbers a coordinate.
SLICE_BYTES = 1 << 20


def _uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to (0, 1), never 0 or 1."""
    return ((x >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-24)


def draws(terms: np.ndarray, coordinates: int):
    """(r, log c, beta) of each term at each coordinate: gamma(2, 1), log of gamma(2, 1), uniform."""
    with np.errstate(over="ignore"):
        seeds = flat.mix(terms[:, None] + flat.mix(np.arange(1, coordinates + 1, dtype=np.uint64))[None, :])
        second = flat.mix(seeds + np.uint64(0x9E3779B97F4A7C15))
    low = np.uint64(40)
    u = [_uniform(seeds), _uniform(seeds << low), _uniform(second), _uniform(second << low)]
    beta = _uniform((seeds ^ second) * np.uint64(0xD6E8FEB86659FD93))
    return -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), beta


def terms(buf: np.ndarray, off: np.ndarray):
    """(row, term, weight) of the distinct terms of each row, by row."""
    start, end, row = flat.words(buf, off)
    long_ = end - start > PIECE
    if long_.any():
        parts = np.where(long_, -(-(end - start) // PIECE), 1)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        row, stop, start = np.repeat(row, parts), np.repeat(end, parts), np.repeat(start, parts) + nth * PIECE
        end = np.where(np.repeat(long_, parts), np.minimum(start + PIECE, stop), stop)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.float32)
    name = flat.span_hash(flat.lowered(buf), start, end)
    order = np.lexsort((name, row))
    row, name, size = row[order], name[order], (end - start)[order]
    edge = np.concatenate(([True], (row[1:] != row[:-1]) | (name[1:] != name[:-1])))
    first = np.flatnonzero(edge)
    return row[first], name[first], np.add.reduceat(size, first).astype(np.float32)


def samples(buf: np.ndarray, off: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """(rows, coordinates) 16-bit samples; a row without terms has only zeros, others never have one."""
    row, name, weight = terms(buf, off)
    out = np.zeros((len(off) - 1, coordinates), np.uint16)
    if not len(row):
        return out
    distinct, inverse = np.unique(name, return_inverse=True)
    at = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1, [len(row)]))
    r, log_c, beta = (np.empty((len(distinct), coordinates), np.float32) for _ in range(3))
    for k in range(0, len(distinct), 4096):
        r[k : k + 4096], log_c[k : k + 4096], beta[k : k + 4096] = draws(distinct[k : k + 4096], coordinates)
    log_w = np.log(weight)
    with np.errstate(over="ignore"):
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            best = np.full(coordinates, np.inf, np.float32)
            pick = np.zeros(coordinates, np.uint64)
            for a in range(lo, hi, 4096):
                own = inverse[a : min(hi, a + 4096)]
                rate, part = r[own], beta[own]
                level = np.floor(log_w[a : a + len(own), None] / rate + part)
                score = log_c[own] - rate * (level - part + 1)
                least = score.argmin(axis=0)
                cols = np.arange(coordinates)
                value = score[least, cols]
                better = value < best
                best[better] = value[better]
                chosen = flat.mix(distinct[own[least]] + level[least, cols].astype(np.int64).view(np.uint64))
                pick[better] = chosen[better]
            out[row[lo]] = (pick >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal coordinates."""
    return (a == b).mean(axis=-1)


def _packed(texts: list[str]):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64)))


def _hex(sample: np.ndarray) -> str:
    return sample.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, fingerprint (hexadecimal, 4 digits a coordinate) for each row. A null or empty text has zeros only."""
    flat.ship()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            buf, off = flat.columns(batch, "text")
            for i, j in flat.slices(off, SLICE_BYTES):
                sample = samples(buf[off[i] : off[j]], off[i : j + 1] - off[i], coordinates)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([_hex(s) for s in sample], pa.string())], ["doc_id", "fingerprint"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _compare(coordinates: int):
    """mapInArrow over rows sorted by (range, tail, id): each row against the one after it in its range."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        held = None
        for batch in batches:
            _, off = flat.columns(batch, "text")
            for i, j in flat.slices(off, SLICE_BYTES):
                part = pa.Table.from_batches([batch.slice(i, j - i)])
                held = part if held is None else pa.concat_tables([held, part])
                texts = held.column("text").to_pylist()
                ranges, tail = held.column("range").to_pylist(), held.column("tail").to_pylist()
                mine = [k for k in range(len(texts) - 1) if not tail[k] and ranges[k] == ranges[k + 1]]
                own = samples(*_packed(texts), coordinates)
                edited = []
                for k in mine:
                    half = len(texts[k]) // 2
                    edited.append(texts[k][: len(texts[k]) - half] + texts[k + 1][:half])
                changed = samples(*_packed(edited), coordinates)
                at = np.array(mine, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        held.column("doc_id").combine_chunks().take(pa.array(at)),
                        pa.array([len(texts[k]) for k in mine], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                        pa.array([_hex(own[k]) for k in mine], pa.string()),
                        pa.array([_hex(c) for c in changed], pa.string()),
                        pa.array(likeness(own[at], changed) if mine else np.zeros(0), pa.float64()),
                        pa.array(likeness(own[at], own[at + 1]) if mine else np.zeros(0), pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
                held = held.slice(len(texts) - 1)

    return flat.released(run)


def compared_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", coordinates: int = COORDINATES, rows_a_range: int = 4000, most_ranges: int = 8192) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of ``docs``.

    The edited text has the last ``n_chars // 2`` code points replaced by the first as many (or all) of the next document's in ascending
    id order; the last document is followed by the first. near_edited and near_next are the shares of coordinates on which the
    fingerprint agrees with the edited text's and the next document's. A null text is the empty one, whose fingerprint is all
    zeros. Ids are integers; null ids come first. Rows that repeat an id follow each other, in the order of their texts. Other
    columns are not read; an empty table gives an empty result.

    Ids are cut into ranges of about as many rows at their quantiles; each gets its own rows and, as its end, the first row of the range after it. So
    every text is sent once and no range needs another's rows.
    """
    from pyspark.ml.feature import Bucketizer

    flat.ship()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    n = texts.count()
    ranges = min(max(1, -(-n // rows_a_range)), most_ranges)
    shares = [(k + 1) / ranges for k in range(ranges - 1)]
    quantiles = texts.agg(F.percentile_approx(F.col("doc_id").cast("double"), shares, 8 * most_ranges)).first()[0] if shares else None
    splits = sorted({-float("inf"), *(quantiles or ()), float("inf")})  # ids of one double, beyond 2**53, share a range
    numbered = texts.withColumn("at", F.coalesce(F.col("doc_id").cast("double"), F.lit(-float("inf"))))
    placed = Bucketizer(splits=splits, inputCol="at", outputCol="place").transform(numbered) if len(splits) > 2 else numbered.withColumn("place", F.lit(0))
    placed = placed.select(F.col("place").cast("int").alias("range"), "doc_id", "text")

    order = Window.orderBy("range")
    heads = placed.groupBy("range").agg(F.min(F.struct("doc_id")).alias("head"))
    heads = heads.select("range", "head.doc_id", F.coalesce(F.lag("range").over(order), F.max("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("back"))
    heads = F.broadcast(heads)  # one row a range, most_ranges at most
    tails = placed.alias("p").join(heads.alias("h"), (F.col("p.range") == F.col("h.range")) & F.col("p.doc_id").eqNullSafe(F.col("h.doc_id")))
    rows = placed.withColumn("tail", F.lit(False)).unionByName(tails.select(F.col("h.back").alias("range"), "p.doc_id", "p.text", F.lit(True).alias("tail")))
    rows = rows.repartition(4 * ranges, "range").sortWithinPartitions("range", "tail", "doc_id", "text")
    return rows.select("range", "tail", "doc_id", "text").mapInArrow(_compare(coordinates), f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
