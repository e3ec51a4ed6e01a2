"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics are counted over whole texts, a batch at a time. Trees are grown on binned statistics of a
bounded sample of labelled rows and kept as flat arrays, so scoring a batch is a few numpy gathers a level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import flat
from dossier.llm.common import cut, sampled

#: Labelled rows that are fitted on at most, chosen by digest.
SAMPLE = 20_000

FEATURES = (
    "log_words log_bytes lower upper digit space newline stop_mark comma pipe bang symbol other_mark high_bytes "
    "word_mean word_std word_max_log short_words long_words capital_words capitalised symbol_words marked_words "
    "distinct_words distinct_pairs top_word log_lines line_words line_std one_word_lines distinct_lines ends_stopped sentence_words"
).split()

_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".?", b",;:", b"|", b"!", b"#$%&*@^~=<>{}[]\\/_+`")


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[at[1:]] - total[at[:-1]]


def _distinct(values: np.ndarray, at: np.ndarray):
    """Distinct values and the largest count of one, in each run."""
    distinct, top = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    for i in np.flatnonzero(np.diff(at)):
        own = np.sort(values[at[i] : at[i + 1]])
        edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
        distinct[i], top[i] = len(edge) - 1, np.diff(edge).max()
    return distinct, top


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, features) of the texts; every statistic of an empty text is 0."""
    rows, size = len(off) - 1, np.diff(off).astype(np.float64)
    kind = np.full(256, len(_CLASSES), np.uint8)
    for k, members in enumerate(_CLASSES):
        kind[np.frombuffer(members, np.uint8)] = k
    kind[128:] = len(_CLASSES) + 1
    kinds = kind[buf]
    owner = np.repeat(np.arange(rows), np.diff(off))
    width = len(_CLASSES) + 2
    shares = np.bincount(owner * width + kinds, minlength=rows * width).reshape(rows, width) / np.maximum(size, 1)[:, None]

    start, end, row = flat.words(buf, off)
    count = np.bincount(row, minlength=rows)
    at = np.concatenate(([0], np.cumsum(count)))
    n, length = np.maximum(count, 1), (end - start).astype(np.float64)
    mean = _sums(length, at) / n
    std = np.sqrt(np.maximum(_sums(length**2, at) / n - mean**2, 0))
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)
    within = np.concatenate((np.zeros((1, 3), np.int64), np.cumsum(np.stack([kinds == 1, kinds == 9, kinds == 0], axis=1), axis=0)))
    inside = within[end] - within[start] if len(start) else np.zeros((0, 3), np.int64)
    head, tail = kinds[start] if len(start) else np.zeros(0), kinds[end - 1] if len(end) else np.zeros(0)
    share = lambda flag: _sums(flag, at) / n
    token = flat.span_hash(flat.lowered(buf), start, end) if len(start) else np.zeros(0, np.uint64)
    distinct, top = _distinct(token, at)
    with np.errstate(over="ignore"):
        pair = flat.mix(token[:-1] * np.uint64(3) + token[1:]) if len(token) else token
    pairs_at = np.minimum(at, len(pair))
    pairs, _ = _distinct(pair, pairs_at)

    breaks = np.flatnonzero((buf == 10) & (owner >= 0))
    line_start = np.sort(np.concatenate((off[:-1][size > 0], breaks + 1)))
    line_start = line_start[line_start < len(buf)]
    line_row = np.searchsorted(off, line_start, side="right") - 1
    line_end = np.append(line_start[1:], len(buf))
    word_at = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    line_words = (word_at[1] - word_at[0]).astype(np.float64)
    lines = np.bincount(line_row, minlength=rows)
    line_at, m = np.concatenate(([0], np.cumsum(lines))), np.maximum(lines, 1)
    line_mean = _sums(line_words, line_at) / m
    line_std = np.sqrt(np.maximum(_sums(line_words**2, line_at) / m - line_mean**2, 0))
    line_hash = flat.span_hash(buf, line_start, line_end) if len(line_start) else np.zeros(0, np.uint64)
    distinct_lines, _ = _distinct(line_hash, line_at)
    stopped = _sums(tail == 5, at)
    return np.stack(
        [
            np.log1p(count),
            np.log1p(size),
            *shares.T,
            mean,
            std,
            np.log1p(longest),
            share(length <= 3),
            share(length >= 12),
            share((inside[:, 0] > 1) & (inside[:, 2] == 0)),
            share(head == 1),
            share(inside[:, 1] > 0),
            share(tail == 9),
            distinct / n,
            pairs / n,
            top / n,
            np.log1p(lines),
            line_mean,
            line_std,
            _sums(line_words == 1, line_at) / m,
            distinct_lines / m,
            stopped / n,
            count / np.maximum(stopped, 1),
        ],
        axis=1,
    ).astype(np.float32)


@dataclass(frozen=True)
class Trees:
    """Complete binary trees in flat arrays: node k's children are 2k+1 and 2k+2; leaves follow the inner nodes."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each row."""
        total = np.full(len(x), self.bias)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, penalty: float = 2.0, least: int = 10) -> Trees:
    """Boosted trees for the logistic loss. Without rows, every score is one half."""
    inner = 2**depth - 1
    if not len(x):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), 0.0)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    chance = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(chance / (1 - chance)))
    score, wide = np.full(len(x), bias), x.shape[1]
    flat_bin = binned + np.arange(wide) * bins
    features, limits, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            base, here = 2**level - 1, 2**level
            at = ((node - base)[:, None] * (wide * bins) + flat_bin).ravel()
            hist = [np.bincount(at, np.repeat(w, wide), here * wide * bins).reshape(here, wide, bins) for w in (g, h, np.ones(len(x)))]
            left = [t.cumsum(axis=2) for t in hist]
            whole = [t[:, :, -1:] for t in left]
            gain = left[0] ** 2 / (left[1] + penalty) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + penalty) - whole[0] ** 2 / (whole[1] + penalty)
            gain[(left[2] < least) | (whole[2] - left[2] < least)] = 0
            best = gain.reshape(here, -1).argmax(axis=1)
            for k in range(here):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[base + k], limit[base + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > limit[node])
        leaf = -rate * np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + penalty)
        score += leaf[node - inner]
        features.append(feature)
        limits.append(limit)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(limits), np.array(leaves), bias)


@flat.released
def _measure(batches):
    import pyarrow as pa

    for batch in batches:
        buf, off = flat.columns(batch, "text")
        for i, j in flat.slices(off):
            stats = statistics(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(list(stats), pa.list_(pa.float32()))], ["doc_id", "stats"])


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Trees learn from at most ``sample`` rows of ``labels`` (doc_id, quality), taken in the order of a digest of their ids, and only
    from those whose crc32 of the id as text leaves a remainder other than 2 modulo 4. Only the text is scored: id,
    language, source and labels are no inputs. Null and empty texts are scored alike. An id with several labels counts
    with their mean; null labels don't count. Without labels every score is 0.5. Repeated rows get equal scores.
    """
    flat.ship()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    measured = cut(texts.mapInArrow(_measure, f"doc_id {id_type}, stats array<float>"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    labelled = cut(measured.join(known, "doc_id").where(~held_out))
    fit = sampled(labelled, F.concat(F.md5(F.col("doc_id").cast("string")), F.md5(F.col("stats").cast("string"))), sample).select("stats", "quality").collect()
    model = grow(np.array([r["stats"] for r in fit], np.float32).reshape(len(fit), len(FEATURES)), np.array([r["quality"] >= 0.5 for r in fit], np.float64))

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(1)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x) if len(x) else np.zeros(0), pa.float64())], ["doc_id", "score"])

    scored = measured.mapInArrow(score, f"doc_id {id_type}, score double")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
