"""Exact removal of byte strings of a given length that occur more than once, by suffix sorting.

A string's *anchor* is the 32-byte gram in it with the least hash (the leftmost of equals). Equal strings have equal anchors
at equal offsets, so strings only have to be compared under one anchor. Neighbouring strings with the same anchor
form a *run*; about two runs start within the length of a string.

1. Anchors that occur once are dropped, with all their strings; a filter of fixed size leaves most of them out before anything is sent.
2. Runs of equal content (128-bit keyed digests of the bytes) are repeated as a whole: one stands for all, the others are only looked up, those of
   the most frequent contents in a table of bounded size, so that no common content meets in a join.
3. The distinct contents under an anchor are compared: the part that any other one shares to the left and to the right of the anchor is cut out,
   the distinct parts are joined, their suffixes sorted by linear grouping (``suffixes``), and a string is repeated if a neighbour in that
   order starts with it.
4. Where more contents meet under one anchor than a task should hold, they are cut into shorter runs under a second anchor within the first one's
   strings, then under a third, which goes through 2 and 3 again; at last each string is a run, and 2 decides. So groups fit into a task whatever the data are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import flat
from dossier.llm.common import checked_broadcast, cut, streams
from dossier.llm.suffixes import suffix_array

GRAM = 32
#: Distinct contents under one anchor that are compared in one task.
MOST_RUNS = 2048
#: Bits of the filter of anchors, whatever the data; more anchors only let more through that is dropped later.
FILTER_BITS = 1 << 27
#: Contents that are looked up in the workers at most, the most frequent ones; the others are joined.
MOST_HOT = 1 << 20
#: And only those that occur at least 2 to the power of this many times.
HOT_FROM = 6
#: Anchors within anchors, before strings stand alone.
LEVELS = 2
_RUN = "anchor bigint, name binary, first int, last int, lead int"


def least_within(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    left = width - have
    return np.minimum(key[: len(key) - left], key[left:]) if left else key


def find_runs(buf: np.ndarray, off: np.ndarray, length: int, level: int = 0):
    """(row, first start, last start, anchor position, anchor's hash) of each run, in order. Levels have hashes of their own."""
    n = len(buf)
    starts, grams = n - length + 1, n - GRAM + 1
    if starts < 1:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, nothing, np.zeros(0, np.uint64)
    view = np.ascontiguousarray(flat.blocks(buf)[: n - 7])
    factor = flat.mix(np.arange(1, 5, dtype=np.uint64) + np.uint64(1000 * level)) | np.uint64(1)
    gram = view[:grams] * factor[0]
    for k in (1, 2, 3):
        gram += view[8 * k : 8 * k + grams] * factor[k]
    gram = flat.mix(gram)
    low = np.uint64(0xFFFFFFFF)
    least = least_within((gram & ~low) | np.arange(grams, dtype=np.uint64), length - GRAM + 1)
    anchor = (least & low).astype(np.int64)
    inside = np.ones(starts, bool)  # strings that end before their row does
    for end in off[1:-1].tolist():
        inside[max(0, end - length + 1) : end] = False
    begins = np.ones(starts, bool)
    np.not_equal(anchor[1:], anchor[:-1], out=begins[1:])
    begins[1:] |= ~inside[:-1]
    begins &= inside
    ends = np.ones(starts, bool)
    ends[:-1] = begins[1:] | ~inside[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends & inside)
    row = np.searchsorted(off, first, side="right") - 1
    return row, first, last, anchor[first], gram[anchor[first]]


def _list_anchors(length: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            buf, off = flat.columns(batch, "text")
            for i, j in flat.slices(off):
                gram = find_runs(buf[off[i] : off[j]], off[i : j + 1] - off[i], length)[4]
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], ["anchor"])

    return flat.released(run)


def _anchor_filter(texts: DataFrame, length: int):
    """A bit for each anchor that occurs more than once, of ``FILTER_BITS`` bits that anchors fall on by hash; shared with all workers."""
    counted = texts.select("text").mapInArrow(_list_anchors(length), "anchor bigint").groupBy("anchor").count().where("count > 1")
    place = F.pmod("anchor", F.lit(FILTER_BITS))
    words = counted.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(anchor, 64) as int))")).alias("bits"))
    found = words.toArrow()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return texts.sparkSession.sparkContext.broadcast(bits)


def _passing(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    at = anchor.view(np.int64) % FILTER_BITS
    return (bits[at >> 6] >> (at & 63)) & 1 != 0


def _list_runs(length: int, shared_bits):
    """mapInArrow: (id, th, text) to the runs under anchors that occur more than once, and some others."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            buf, off = flat.columns(batch, "text")
            for i, j in flat.slices(off):
                part = buf[off[i] : off[j]]
                row, first, last, anchor, gram = find_runs(part, off[i : j + 1] - off[i], length)
                kept = _passing(shared_bits.value, gram)
                row, first, last, anchor, gram = (x[kept] for x in (row, first, last, anchor, gram))
                base, at = (off[i:j] - off[i])[row], pa.array(row + i)
                name = pa.array(flat.names(part, first, last + length), pa.binary())
                numbers = [pa.array(x.astype(np.int32)) for x in (first - base, last - base, anchor - first)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(gram.view(np.int64)), name, *numbers], ["id", "th", "anchor", "name", "first", "last", "lead"])

    return flat.released(run)


def _extract(length: int):
    """mapInArrow: texts with their listed runs to the runs' bytes."""

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                slice_ = batch.slice(lo, 64)
                listed, texts = slice_.column(3).to_pylist(), slice_.column(2).to_pylist()
                at = pa.array([k for k, runs in enumerate(listed) for _ in runs], pa.int64())
                columns = [pa.array([r[c] for runs in listed for r in runs], t) for c, t in zip(("anchor", "first", "lead", "open", "hot"), kinds, strict=True)]
                parts = [raw[r["first"] : r["last"] + length] for raw, runs in zip(texts, listed, strict=True) for r in runs]
                yield pa.RecordBatch.from_arrays([slice_.column(0).take(at), slice_.column(1).take(at), *columns, pa.array(parts, pa.binary())], ["id", "th", "anchor", "first", "lead", "open", "hot", "part"])

    return flat.released(run)


def _split(length: int, level: int):
    """mapInArrow: runs with their bytes to shorter runs under anchors of this level; beyond the last level, to single strings."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            old, lead, first_ = (batch.column(c).to_numpy() for c in ("anchor", "lead", "first"))
            for k in range(batch.num_rows):
                part = np.frombuffer(batch.column("part")[k].as_py(), np.uint8)
                if level <= LEVELS:
                    _, first, last, anchor, gram = find_runs(part, np.array([0, len(part)]), length, level)
                else:
                    first = last = anchor = np.arange(len(part) - length + 1)
                    gram = np.zeros(len(first), np.uint64)
                with np.errstate(over="ignore"):
                    key = flat.mix(flat.mix(gram + np.uint64(level)) + flat.mix(old[k : k + 1].view(np.uint64)) + (anchor - lead[k]).astype(np.uint64))
                same = pa.array(np.full(len(first), k))
                texts = [part[s : e + length].tobytes() for s, e in zip(first.tolist(), last.tolist(), strict=True)]
                names = pa.array(flat.names(part, first, last + length), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(same), batch.column("th").take(same), pa.array(key.view(np.int64)), names, pa.array((first + first_[k]).astype(np.int32)), pa.array((last + first_[k]).astype(np.int32)), pa.array((anchor - first).astype(np.int32)), batch.column("open").take(same), pa.array(texts, pa.binary())],
                    ["id", "th", "anchor", "name", "first", "last", "lead", "open", "part"],
                )

    return flat.released(run)


def shared(contexts: list[bytes]) -> list[int]:
    """The longest prefix that each has in common with another."""
    order = sorted(range(len(contexts)), key=contexts.__getitem__)
    out = [0] * len(contexts)
    for x, y in zip(order, order[1:], strict=False):
        a, b = contexts[x], contexts[y]
        n = min(len(a), len(b))
        if a[:n] != b[:n]:
            lo, hi = 0, n
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
            n = lo
        out[x], out[y] = max(out[x], n), max(out[y], n)
    return out


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of some distinct parts, where strings of ``length`` bytes start that also start elsewhere in them."""
    size = np.array([len(p) + 1 for p in parts])
    base = np.concatenate(([0], np.cumsum(size)))
    joined = np.ones(base[-1] + 1, np.uint16)  # a 1 ends each part, the least value all of them
    joined[-1] = 0
    inside = np.zeros(len(joined), bool)
    for b, p in zip(base, parts, strict=False):
        joined[b : b + len(p)] = np.frombuffer(p, np.uint8).astype(np.uint16) + 2
        inside[b : b + max(0, len(p) - length + 1)] = True
    order = np.frombuffer(suffix_array(joined), np.int32)
    raw = joined.tobytes()
    hit = np.zeros(len(joined), bool)
    x, y = order[:-1], order[1:]
    both = np.flatnonzero(inside[x] & inside[y])
    for i, j in zip(x[both].tolist(), y[both].tolist(), strict=True):
        if raw[2 * i : 2 * (i + length)] == raw[2 * j : 2 * (j + length)]:
            hit[i] = hit[j] = True
    return [np.flatnonzero(hit[b : b + len(p)]) for b, p in zip(base, parts, strict=False)]


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte spans covered by strings at these ascending starts, one for each unbroken series."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.concatenate(([True], np.diff(starts) > 1)))
    last = np.append(new[1:], len(starts)) - 1
    return [(int(starts[a]), int(starts[b]) + length) for a, b in zip(new, last, strict=True)]


def compare_runs(parts: list[bytes], lead: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each run under one anchor, the spans of its repeated strings."""
    right = shared([p[a:] for p, a in zip(parts, lead, strict=True)])
    left = shared([p[:a][::-1] for p, a in zip(parts, lead, strict=True)])
    from_ = [a - n for a, n in zip(lead, left, strict=True)]
    kept = [p[f : a + r] for p, f, a, r in zip(parts, from_, lead, right, strict=True)]
    count: dict[bytes, int] = {}
    for k in kept:
        if len(k) >= length:
            count[k] = count.get(k, 0) + 1
    found = {k: [(0, len(k))] for k, c in count.items() if c > 1}
    if len(found) < len(count) and len(count) > 1:
        distinct = sorted(count)
        for k, starts in zip(distinct, repeated_starts(distinct, length), strict=True):
            found.setdefault(k, spans_of(starts, length))
    return [[(f + s, f + e) for s, e in found.get(k, ())] for k, f in zip(kept, from_, strict=True)]


def _compare(length: int):
    def run(batches):
        import pyarrow as pa

        for batch in streams(batches, ["anchor"], most=1024):
            anchor = batch.column("anchor").to_numpy()
            parts, lead = batch.column("part").to_pylist(), batch.column("lead").to_pylist()
            first, open_ = batch.column("first").to_pylist(), batch.column("open").to_pylist()
            edge = [0, *(np.flatnonzero(np.diff(anchor)) + 1).tolist(), len(anchor)]
            row, start, end = [], [], []
            for lo, hi in zip(edge, edge[1:], strict=False):
                if hi - lo < 2:
                    continue
                for k, spans in enumerate(compare_runs(parts[lo:hi], lead[lo:hi], length), lo):
                    if open_[k]:
                        for s, e in spans:
                            row.append(k)
                            start.append(first[k] + s)
                            end.append(first[k] + e)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("th").take(at), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["id", "th", "start", "end"])

    return flat.released(run)


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover; touching spans are one run."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def rest(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for start, end in spans:
        kept.append(raw[at:start])
        at = end
    return b"".join([*kept, raw[at:]])


KEY = ["id", "th"]


def _texts(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """(id, th, text): texts as bytes, a null one as none. id is a struct, so that null ids are equal; th tells texts under one id apart."""
    return docs.select(F.struct(F.col(id_col).alias("v")).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *more)


def _hottest(contents: DataFrame):
    """(least count, names): the contents that occur most often, ``MOST_HOT`` at most, as sorted halves of their names, shared with all workers."""
    tally = {int(r["b"]): r["count"] for r in contents.where("k > 1").groupBy(F.floor(F.log2("k")).alias("b")).count().collect()}  # one row a power of two
    power, total = 63, 0
    while power > HOT_FROM and total + tally.get(power - 1, 0) <= MOST_HOT:
        power -= 1
        total += tally.get(power, 0)
    found = contents.where(F.col("k") >= 2**power).select("name").toArrow().column("name").to_pylist() if total else []
    halves = np.frombuffer(b"".join(sorted(found)), ">u8").reshape(-1, 2).astype(np.uint64)
    return 2**power, contents.sparkSession.sparkContext.broadcast(halves)


def _hot_spans(length: int, shared_names):
    """mapInArrow: runs, in order of their texts, to the spans of those with the hottest contents; runs that follow each other are one span."""

    def run(batches):
        import pyarrow as pa

        hot = shared_names.value
        for batch in batches:
            if not len(hot) or not batch.num_rows:
                continue
            column = batch.column("name").cast(pa.binary())
            start = np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0]
            names = np.frombuffer(column.buffers()[2], ">u8", 2 * len(column), int(start)).reshape(-1, 2).astype(np.uint64)
            low, high = np.searchsorted(hot[:, 0], names[:, 0], "left"), np.searchsorted(hot[:, 0], names[:, 0], "right")
            hit = np.zeros(len(names), bool)
            for k in range(int((high - low).max(initial=0))):  # names that share their first half are a few at most
                at = np.minimum(low + k, len(hot) - 1)
                hit |= (low + k < high) & (hot[at, 1] == names[:, 1])
            at = np.flatnonzero(hit)
            first, last = batch.column("first").to_numpy()[at], batch.column("last").to_numpy()[at] + length
            rows = pa.array(at)
            id_, th = batch.column("id").take(rows), batch.column("th").take(rows)
            keys = list(zip(id_.to_pylist(), th.to_pylist(), strict=True))
            begins = [k for k in range(len(at)) if not k or keys[k] != keys[k - 1] or first[k] > last[k - 1]]
            ends = [*(k - 1 for k in begins[1:]), len(at) - 1] if begins else []
            kept = pa.array(begins, pa.int64())
            yield pa.RecordBatch.from_arrays([id_.take(kept), th.take(kept), pa.array(first[begins].astype(np.int32)), pa.array(last[ends].astype(np.int32))], [*KEY, "start", "end"])

    return flat.released(run)


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """(id, th, spans) of the ``texts(id, th, text)`` that hold strings of ``length`` bytes which also start anywhere else."""
    mine = f"id {texts.schema['id'].dataType.simpleString()}, th bigint"
    runs = cut(texts.mapInArrow(_list_runs(length, _anchor_filter(texts, length)), f"{mine}, {_RUN}"))
    end = (F.col("last") + length).alias("end")

    # A content's first run stands for it; the others are only looked up, so that no common content is gathered in one task.
    contents = cut(runs.groupBy("name").agg(F.count("*").alias("k"), F.min(F.struct(*KEY, "first", "last", "lead", "anchor")).alias("one")))
    often, hot_names = _hottest(contents)
    rare = contents.where("k > 1").where(F.col("k") < often).select("name")
    whole = runs.join(rare, "name", "left_semi").select(*KEY, F.col("first").alias("start"), end)
    whole = cut(whole.unionByName(runs.mapInArrow(_hot_spans(length, hot_names), f"{mine}, start int, end int")))
    ones = contents.select("one.*", (F.col("k") == 1).alias("open"))
    held = ones.groupBy("anchor").agg(F.count("*").alias("n"), F.max("open").alias("any")).where("any and n > 1").select("anchor", (F.col("n") > MOST_RUNS).alias("hot"))
    listed = ones.join(held, "anchor").groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "first", "last", "lead", "open", "hot")).alias("runs"))
    parts = texts.join(checked_broadcast(listed), KEY).select(*KEY, "text", "runs").dropDuplicates(KEY)
    parts = cut(parts.mapInArrow(_extract(length), f"{mine}, anchor bigint, first int, lead int, open boolean, hot boolean, part binary"))

    def compared(parts: DataFrame) -> DataFrame:
        return parts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(length), f"{mine}, start int, end int")

    marks, hot, level = whole.unionByName(compared(parts.where("not hot"))), parts.where("hot"), 0
    while not hot.isEmpty():
        level += 1
        runs = cut(hot.mapInArrow(_split(length, level), f"{mine}, {_RUN}, open boolean, part binary"))
        contents = cut(runs.groupBy("anchor", "name").agg(F.count("*").alias("k"), F.max("open").alias("open"), F.min(F.struct(*KEY, "first", "lead", "part")).alias("one")))
        often = contents.where("k > 1").select("anchor", "name")
        marks = marks.unionByName(runs.where("open").join(often, ["anchor", "name"], "left_semi").select(*KEY, F.col("first").alias("start"), end))
        if level > LEVELS:
            break  # single strings, of which each equal one has been found
        ones = contents.select("anchor", "one.*", ((F.col("k") == 1) & F.col("open")).alias("open"))
        held = ones.groupBy("anchor").agg(F.count("*").alias("n"), F.max("open").alias("any")).where("any and n > 1").select("anchor", (F.col("n") > MOST_RUNS).alias("hot"))
        parts = cut(ones.join(held, "anchor"))
        marks, hot = marks.unionByName(compared(parts.where("not hot"))), parts.where("hot")
    return cut(marks.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans")).mapInArrow(_merge, f"{mine}, spans array<struct<start: int, end: int>>"))


@flat.released
def _merge(batches):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        runs = [[{"start": s, "end": e} for s, e in merged(own)] for own in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, kind)], [*KEY, "spans"])


def _regions(length: int):
    """mapInArrow: (id, th, text, spans) to the spans of at least ``length`` bytes as texts of their own."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            row, base, text = [], [], []
            for k, (raw, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                for s in spans:
                    if s["end"] - s["start"] >= length:
                        row.append(k)
                        base.append(s["start"])
                        text.append(raw[s["start"] : s["end"]])
            at, base = pa.array(row, pa.int64()), pa.array(base, pa.int64())
            id_ = pa.StructArray.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["id", "th"])
            yield pa.RecordBatch.from_arrays([id_, base, pa.array(text, pa.binary())], [*KEY, "text"])

    return flat.released(run)


def _measure(passage_words: int):
    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], [], []]
            for raw, near, far in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                runs = merged(far or [])
                values = len(raw), sum(e - s for s, e in runs), len(runs), hashlib.sha256(rest(raw, runs)).hexdigest(), sum(len(raw[s["start"] : s["end"]].split()) > passage_words for s in near or [])
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"])

    return flat.released(run)


def remove_repeats(docs: DataFrame, *, length: int = 400, passage: int = 200, passage_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages for each row of ``docs``.

    Removed is every byte covered by a string of ``length`` bytes that also starts anywhere else, in another document or the same one;
    overlapping occurrences count, and strings are judged on the input. Texts are taken as UTF-8 bytes, a null one as empty;
    texts shorter than ``length`` lose nothing. n_passages counts the repeated passages of more than ``passage_words`` words, many of which are shorter
    than ``length``: maximal runs of bytes covered by repeated strings of ``passage`` bytes. Repeated rows are documents of their own, so copies lose all
    strings. Other columns are not read; an empty table gives an empty result.

    A repeated string of ``length`` bytes lies inside such a run at both places (``passage`` is not longer), so the longer strings are sought in the runs only.
    """
    flat.ship()
    passage = min(passage, length)
    texts = _texts(docs, id_col, text_col)
    near = repeated_spans(texts, passage)
    if length > passage:
        kind = f"struct<id: {texts.schema['id'].dataType.simpleString()}, th: bigint>"
        regions = cut(texts.join(checked_broadcast(near), KEY).select(*KEY, "text", "spans").mapInArrow(_regions(length), f"id {kind}, th bigint, text binary"))
        far = repeated_spans(regions, length).select("id.id", "id.th", F.col("th").cast("int").alias("base"), F.explode("spans").alias("s"))
        far = far.groupBy(*KEY).agg(F.collect_list(F.struct((F.col("base") + F.col("s.start")).alias("start"), (F.col("base") + F.col("s.end")).alias("end"))).alias("far"))
        spans = near.join(far, KEY, "left")
    else:
        spans = near.withColumn("far", F.col("spans"))
    rows = texts.join(checked_broadcast(spans), KEY, "left").select("id", "text", "spans", "far")
    kind = texts.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_measure(passage_words), f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint").select(F.col("id.v").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages")


def without_repeats(docs: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated strings cut out of the text, all columns kept, whatever their names.

    A character that loses a byte goes as a whole, so that the text stays UTF-8. Null and short texts stay as they are; repeated rows lose all strings.
    """
    flat.ship()
    spans = checked_broadcast(repeated_spans(_texts(docs, id_col, text_col), length))

    @F.pandas_udf("string")
    def left(text, spans):
        import pandas as pd

        cuts = lambda s: [(x["start"], x["end"]) for x in s]
        return pd.Series([t if t is None or s is None else rest(t.encode(), cuts(s)).decode(errors="ignore") for t, s in zip(text, spans, strict=True)], dtype=object)

    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(whole, F.struct(F.col(id_col).alias("v")).alias("id"), F.xxhash64(F.col(text_col)).alias("th")).join(spans, KEY, "left")
    return rows.select(*(left(F.col("_row")[c], F.col("spans")).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))
