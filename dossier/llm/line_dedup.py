"""Substring dedup by line hashing: every repeated unit but the earliest goes.

A unit is a line, or a sentence of a line: passages are also copied into the middle of
paragraphs, where no whole line repeats. Units are normalised (A-Z lowered, white space
collapsed), named by 128-bit digests and grouped over the whole corpus. The
occurrence with the least (id, unit number) stays; later ones go, with their original offsets on record.
Units of few words are compared in runs, so that passages of short sentences are found.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm import flat
from dossier.llm.common import checked_broadcast, cut

UNIT = "unit int, start bigint, length bigint, n_words int, h1 bigint, h2 bigint"


def windows(owner: np.ndarray, line: np.ndarray, size: np.ndarray, min_words: int, min_line_words: int):
    """(first unit, last unit) of the runs that are compared: from each unit on, and up to each unit, as few as have ``min_words`` words together; and
    whole lines of fewer, but ``min_line_words`` at least.

    Any series of units that has ``min_words`` words is covered by the runs inside it.
    """
    n = len(size)
    sums = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(n)
    on = np.searchsorted(sums, sums[:-1] + min_words) - 1
    back = np.searchsorted(sums, sums[1:] - min_words, side="right") - 1
    head = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    tail = np.append(head[1:], n) - 1
    words = sums[tail + 1] - sums[head]
    short = (words >= min_line_words) & (words < min_words)
    ahead, behind = on < n, back >= 0
    ahead[ahead] = owner[on[ahead]] == owner[at[ahead]]
    behind[behind] = owner[back[behind]] == owner[at[behind]]
    pairs = np.concatenate((at[ahead] * n + on[ahead], back[behind] * n + at[behind], head[short] * n + tail[short]))
    pairs = np.unique(pairs)
    return pairs // n, pairs % n


def units(buf: np.ndarray, off: np.ndarray, min_words: int, min_line_words: int = 3):
    """(row, first unit's number, byte start, byte end, words, halves of the name) of the ``windows`` of units.

    A unit ends at a newline, at a row's end, or after a word that ends in ``.``, ``!`` or ``?``.
    """
    start, end, row = flat.words(buf, off)
    n = len(start)
    if not n:
        return (np.zeros(0, np.int64),) * 5 + (np.zeros((0, 2), np.int64),)
    token = flat.span_hash(flat.lowered(buf), start, end)
    lines = np.concatenate(([0], np.cumsum(buf == 10)))
    stop = np.isin(buf[end - 1], np.frombuffer(b".!?", np.uint8))
    new = np.ones(n, bool)
    new[1:] = stop[:-1] | (row[1:] != row[:-1]) | (lines[start[1:]] != lines[end[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n)
    size = last - first
    owner = row[first]
    number = np.arange(len(first)) - np.searchsorted(owner, owner, side="left")
    line = np.cumsum(np.concatenate(([True], (owner[1:] != owner[:-1]) | (lines[start[first[1:]]] != lines[start[first[:-1]]]))))
    i, j = windows(owner, line, size, min_words, min_line_words)
    first, last = first[i], last[j]
    return owner[i], number[i], start[first], end[last - 1], last - first, np.frombuffer(b"".join(flat.names(token, first, last)), np.int64).reshape(-1, 2)


def _list_units(min_words: int, min_line_words: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            buf, off = flat.columns(batch, "text")
            ids = batch.column(0)
            for i, j in flat.slices(off):
                row, number, start, end, size, name = units(buf[off[i] : off[j]], off[i : j + 1] - off[i], min_words, min_line_words)
                base = off[i : j + 1][row] - off[i] if len(row) else row
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row + i)), pa.array(number, pa.int32()), pa.array(start - base, pa.int64()), pa.array(end - start, pa.int64()), pa.array(size, pa.int32()), pa.array(name[:, 0]), pa.array(name[:, 1])],
                    ["doc_id", "unit", "start", "length", "n_words", "h1", "h2"],
                )

    return flat.released(run)


def repeated_units(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8, min_line_words: int = 3) -> DataFrame:
    """One row for each unit that goes: doc_id, unit, start, length, n_words, first_doc_id, first_unit, occurrences.

    start and length are byte offsets in the original text. Units of fewer than ``min_words`` words count together with those
    beside them: a row is a run of units, ``unit`` is its first, and runs may overlap. Whole lines count from ``min_line_words``
    words on; a shorter line or a single short sentence between others says too little and stays. Null, empty and wordless texts have no units.
    A unit that repeats within its own document goes too. Of rows that repeat an id, ``copy`` (from 0) tells the equal units apart, and only
    one occurrence stays. A null id ranks last. Other columns are not read; an empty table gives an empty result.
    """
    flat.ship()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    listed = cut(texts.mapInArrow(_list_units(min_words, min_line_words), f"doc_id {id_type}, {UNIT}"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("unit"))
    firsts = listed.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count("*").alias("occurrences")).where("occurrences > 1")
    firsts = cut(firsts)  # written, so that a frequent unit's side of the join can be split at run time
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("unit") == F.col("first.unit"))
    out = ["doc_id", "unit", "start", "length", "n_words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.unit").alias("first_unit"), "occurrences"]
    later = listed.join(firsts, ["h1", "h2"]).where(~is_first).select(*out, F.lit(0).alias("copy"))
    # A unit's first occurrence stands in more than one row only where rows repeat an id and a text: only those are looked at again.
    again = cut(texts.groupBy(F.struct("doc_id").alias("id"), F.xxhash64("text").alias("th")).count().where("count > 1").select("id").distinct())
    if again.isEmpty():
        return later
    own = listed.withColumn("id", F.struct("doc_id")).join(checked_broadcast(again), "id", "left_semi").drop("id")
    copies = own.join(firsts, ["h1", "h2"]).where(is_first).groupBy("doc_id", "unit", "start", "length", "n_words", "first", "occurrences", "h1", "h2").agg(F.count("*").alias("k")).where("k > 1")
    return later.unionByName(copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(*out, F.col("copy").cast("int").alias("copy")))


def without_units(docs: DataFrame, removed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed units cut out of the text; all columns stay. ``kept_text`` holds what is left.

    Of rows that repeat an id and a text, the first occurrence's units stay in one, which is chosen by no rule that a user could rely on.
    """
    flat.ship()
    own = F.struct("start", "length")
    spans = removed.groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("copy") == 0, own))).alias("always"), F.array_sort(F.collect_set(F.when(F.col("copy") > 0, own))).alias("once")
    )
    spans = spans.select(F.struct(F.col("doc_id").alias("id"), "always", "once").alias("_removed"))

    @F.pandas_udf("string")
    def rest(text, always, once, nth):
        import pandas as pd

        out = []
        for t, cuts, more, k in zip(text, always, once, nth, strict=True):
            if t is None or cuts is None:
                out.append(t)
                continue
            raw, at, kept = t.encode(), 0, []
            for c in sorted([*cuts, *(more if k > 1 else [])], key=lambda c: (c["start"], c["length"])):
                kept.append(raw[at : c["start"]])
                at = max(at, c["start"] + c["length"])
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pd.Series(out, dtype=object)

    row = F.struct(*(F.col(c) for c in docs.columns))
    rows = docs.select(row.alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"), F.col(text_col).alias("_text"))
    joined = rows.join(spans, F.col("_id").eqNullSafe(F.col("_removed.id")), "left")
    marked = joined.withColumn("_nth", F.lit(1))
    if not removed.where("copy > 0").isEmpty():  # only rows with such units are numbered
        several = F.coalesce(F.size("_removed.once"), F.lit(0)) > 0
        marked = marked.where(~several).unionByName(joined.where(several).withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_text"))))
    return marked.withColumn("_kept", rest("_text", "_removed.always", "_removed.once", "_nth")).select("_row.*", F.col("_kept").alias("kept_text"))
