"""Best-fit packing of token pieces into sequences by a linear grouping scheme.

A document longer than a sequence is cut into full pieces and one shorter first piece; full pieces are sequences of
their own. For the others only the number of pieces of each length matters, so the plan is made on a histogram with at
most ``capacity`` entries, whatever the data:

1. Large lengths are put in groups of equal cardinality and rounded up to the group's largest.
2. Configurations of these few sizes fill sequences: repeatedly the fullest configuration with the largest size that is left
   (a bounded knapsack) is applied as often as its sizes last.
3. Actual lengths take the places of their group's rounded size; runs of equal compositions stay runs.
4. Small lengths go, largest first, where the least room is left that still takes them.

The plan is a list of runs (length, first rank, count, first sequence, offset); a piece finds its run by the rank it has among
pieces of its length, which comes from counts of 4096 digest runs and the order inside one run.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm import flat
from dossier.llm.common import cut

END_OF_TEXT = 2


# --- tokens ---------------------------------------------------------------------------------


def cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of chunks whose tokens don't depend on what stands around them.

    The pre-tokeniser takes at most one space with what follows it and lets no token span a space that has
    other characters on both sides, nor a lone newline or tab. Text is cut before such white space only, and only where both neighbours are
    surely no white space themselves: printable ASCII, or two-byte letters.
    """
    n = len(buf)
    first = off[:-1][np.diff(off) > 0]
    if n < 4:
        return first
    ascii_ = (buf > 0x20) & (buf < 0x7F)
    lead = (buf >= 0xC3) & (buf <= 0xDF)
    before = ascii_.copy()
    before[1:] |= lead[:-1]
    after = ascii_ | lead
    space = (buf == 0x20) | (buf == 0x0A) | (buf == 0x09)
    at = np.flatnonzero(space[1:-1] & before[:-2] & after[2:]) + 1
    ends = np.zeros(n + 1, bool)
    ends[off] = True
    at = at[~ends[at] & ~ends[at + 1]]
    return np.union1d(first, at)


class Tokens:
    """Token ids of whole batches: each distinct chunk is encoded once and its ids are gathered."""

    #: Distinct chunks that are remembered, by their bytes; beyond it the memory starts anew.
    KEPT = 1 << 18

    def __init__(self, tokenizer: str):
        import base64
        import os

        self.path, self.whole, self.fast = tokenizer, None, None
        ranks = tokenizer.removesuffix(".json") + ".tiktoken"
        if tokenizer.endswith("byte_bpe_50k.json") and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.clear()

    def clear(self):
        from array import array

        self.number, self.ids, self.starts = {}, array("I"), array("q", [0])

    @property
    def tokenizer(self):
        """The tokenizer file, read only when a chunk needs it, as it takes more memory than the ranks."""
        if self.whole is None:
            import os

            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.whole = Tokenizer.from_file(self.path)
        return self.whole

    def encode(self, chunk: bytes) -> list[int]:
        text = chunk.decode()
        if self.fast is None or "<|" in text:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def __call__(self, buf: np.ndarray, off: np.ndarray):
        """(ids, offsets of the rows' ids)."""
        start = cuts(buf, off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        end = np.append(start[1:], len(buf))
        _, place, inverse = np.unique(flat.span_hash(buf, start, end), return_index=True, return_inverse=True)
        if not flat.same_bytes(buf, start, end, start[place][inverse]).all():  # chunks of one hash that differ: all are looked up
            place = inverse = np.arange(len(start))
        if len(self.number) > self.KEPT:
            self.clear()
        known = np.empty(len(place), np.int64)
        raw = buf.tobytes()
        number, ids, starts = self.number, self.ids, self.starts
        for k, (s, e) in enumerate(zip(start[place].tolist(), end[place].tolist(), strict=True)):
            chunk = raw[s:e]
            at = number.get(chunk)
            if at is None:
                at = number[chunk] = len(starts) - 1
                ids.extend(self.encode(chunk))
                starts.append(len(ids))
            known[k] = at
        pool, at = np.array(ids, np.uint32), np.array(starts)
        of = known[inverse]
        size = at[of + 1] - at[of]
        last = np.cumsum(size)
        out = pool[np.repeat(at[of] - (last - size), size) + np.arange(last[-1])]
        rows = np.concatenate(([0], last))[np.searchsorted(start, off)]
        return out, rows


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, and before them the rest if there is one."""
    rest = n % capacity
    return [(0, rest)] * bool(rest) + [(s, capacity) for s in range(rest, n, capacity)]


def _tokenize(tokenizer: str, capacity: int):
    def run(batches):
        import zlib

        import pyarrow as pa

        tokens = Tokens(tokenizer)
        for batch in batches:
            buf, off = flat.columns(batch, "text")
            for i, j in flat.slices(off, 512 << 10):
                ids, at = tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                sizes, sums = [], []
                for r in range(j - i):
                    own = np.append(ids[at[r] : at[r + 1]], END_OF_TEXT).astype("<u4")
                    sizes.append(len(own))
                    sums.append([zlib.crc32(own[s : s + n].tobytes()) for s, n in pieces(len(own), capacity)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["doc_id", "n_tokens", "crcs"])

    return flat.released(run)


# --- the plan -------------------------------------------------------------------------------


def fullest(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """How often each size stands in the fullest configuration; sizes descend, and larger ones are taken first."""
    reach = [1]
    for size, count in zip(reversed(sizes), reversed(counts), strict=True):
        have, more, step = reach[-1], min(count, capacity // size), 1
        while more > 0:
            step = min(step, more)
            have |= have << (size * step)
            more, step = more - step, step * 2
        reach.append(have & ((1 << (capacity + 1)) - 1))
    left, used = reach[-1].bit_length() - 1, []
    for k, (size, count) in enumerate(zip(sizes, counts, strict=True)):
        below, take = reach[len(sizes) - 1 - k], min(count, left // size)
        while not below >> (left - take * size) & 1:
            take -= 1
        used.append(take)
        left -= take * size
    return used


def plan(histogram: dict[int, int], capacity: int, groups: int = 1024, small: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece of every length."""
    small = capacity // 4 if small is None else small
    large = sorted((n for n in histogram if n > small and histogram[n] > 0), reverse=True)
    total = sum(histogram[n] for n in large)
    rank, runs, sequence = defaultdict(int), [], 0
    bins: list[tuple[int, int, int]] = []  # (room, first sequence, count)

    # 1. groups of equal cardinality, by runs of equal lengths
    queue: list[list[list[int]]] = []
    room = 0
    for n in large:
        left = histogram[n]
        while left:
            if not room:
                queue.append([])
                room = -(-total // groups)
            take = min(left, room)
            queue[-1].append([n, take])
            left, room = left - take, room - take
    sizes, counts = [g[0][0] for g in queue], [sum(c for _, c in g) for g in queue]

    # 2. and 3. the fullest configuration as often as it lasts, with actual lengths in its places
    while any(counts):
        top = next(g for g, c in enumerate(counts) if c)
        used = fullest(sizes, [c - (g == top) for g, c in enumerate(counts)], capacity - sizes[top])
        used[top] += 1
        times = min(c // u for c, u in zip(counts, used, strict=True) if u)
        slots = []
        for g, u in enumerate(used):
            for _ in range(u):
                need, own = times, []
                while need:
                    n, have = queue[g][0]
                    take = min(need, have)
                    own.append((n, take))
                    queue[g][0][1] -= take
                    need -= take
                    if not queue[g][0][1]:
                        queue[g].pop(0)
                slots.append(own)
            counts[g] -= u * times
        ends = sorted({0, times, *(e for own in slots for e in np.cumsum([c for _, c in own]).tolist())})
        at = [0] * len(slots)
        gone = [0] * len(slots)
        for lo, hi in zip(ends, ends[1:], strict=False):
            offset = 0
            for s, own in enumerate(slots):
                n, have = own[at[s]]
                runs.append((n, rank[n], hi - lo, sequence, offset))
                rank[n] += hi - lo
                offset += n
                gone[s] += hi - lo
                if gone[s] == have:
                    at[s], gone[s] = at[s] + 1, 0
            bins.append((capacity - offset, sequence, hi - lo))
            sequence += hi - lo

    # 4. best fit of the small ones
    bins.sort()
    for n in sorted((n for n in histogram if n <= small and histogram[n] > 0), reverse=True):
        left = histogram[n]
        while left:
            k = bisect.bisect_left(bins, (n, -1, -1))
            if k == len(bins):
                each = capacity // n
                whole = left // each
                fresh = (capacity, sequence, whole) if whole else (capacity, sequence, 1)
                bisect.insort(bins, fresh)
                sequence += fresh[2]
                continue
            free, first, count = bins.pop(k)
            fit = free // n
            if left >= fit * count:
                for f in range(fit):
                    runs.append((n, rank[n], count, first, capacity - free + f * n))
                    rank[n] += count
                left -= fit * count
                bisect.insort(bins, (free - fit * n, first, count))
            elif left >= fit:
                some = left // fit
                for f in range(fit):
                    runs.append((n, rank[n], some, first, capacity - free + f * n))
                    rank[n] += some
                left -= fit * some
                bisect.insort(bins, (free - fit * n, first, some))
                bisect.insort(bins, (free, first + some, count - some))
            else:
                for f in range(left):
                    runs.append((n, rank[n], 1, first, capacity - free + f * n))
                    rank[n] += 1
                bisect.insort(bins, (free - left * n, first, 1))
                if count > 1:
                    bisect.insort(bins, (free, first + 1, count - 1))
                left = 0
    return runs


# --- the operator ---------------------------------------------------------------------------


def pack_documents(docs: DataFrame, *, tokenizer: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of the tokenizer file, without special tokens added, and then id 2; a null or empty text is that
    one id. Only documents longer than ``capacity`` are cut. Full pieces have negative sequence ids, plans' sequences count from 0.
    Repeated rows are packed as often as they stand. Other columns are not read; an empty table gives an empty result.
    """
    flat.ship()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    tokenized = cut(texts.mapInArrow(_tokenize(tokenizer, capacity), f"doc_id {id_type}, n_tokens bigint, crcs array<bigint>"))
    rest = (F.col("n_tokens") % capacity).cast("int")
    rows = tokenized.withColumns({"rest": rest, "full": (F.col("n_tokens") - rest).cast("long") / capacity, "turn": F.xxhash64("doc_id", "n_tokens", "crcs")})
    rows = rows.withColumns({"full": F.col("full").cast("long"), "run": F.pmod("turn", F.lit(4096)).cast("int")})

    tally = rows.groupBy("rest", "run").agg(F.count("*").alias("k"), F.sum("full").alias("f"))
    by_rest = tally.groupBy("rest").agg(F.sum("k").alias("k")).where("rest > 0").collect()
    runs = plan({r["rest"]: r["k"] for r in by_rest}, capacity)
    runs.sort()
    key = np.array([r[:2] for r in runs], np.int64).reshape(-1, 2)
    key, value = key[:, 0] << 44 | key[:, 1], np.array([r[3:] for r in runs], np.int64).reshape(-1, 2)

    tally = tally.withColumn("k0", F.sum("k").over(Window.partitionBy("rest").orderBy("run")) - F.col("k"))
    tally = tally.withColumn("f0", F.sum("f").over(Window.partitionBy("run").orderBy("rest")) - F.col("f"))
    per_run = tally.groupBy("run").agg(F.sum("f").alias("f"))
    per_run = per_run.select("run", (F.sum("f").over(Window.orderBy("run")) - F.col("f")).alias("f1"))
    starts = tally.join(F.broadcast(per_run), "run").select("rest", "run", "k0", (F.col("f0") + F.col("f1")).alias("f0"))  # 4096 rows at most
    inner = Window.partitionBy("rest", "run").orderBy("turn", "doc_id")
    ranked = rows.join(starts, ["rest", "run"]).withColumn("rank", F.col("k0") + F.row_number().over(inner) - 1)
    ranked = ranked.withColumn("full_rank", F.col("f0") + F.sum("full").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full"))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            rest, rank, full, full_rank, n = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1, 6))
            has = rest > 0
            count = full + has
            owner = np.repeat(np.arange(batch.num_rows), count)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            short = has[owner] & (number == 0)
            nth = number - has[owner]
            length = np.where(short, rest[owner], capacity)
            sequence, offset = -1 - (full_rank[owner] + nth), np.zeros(len(owner), np.int64)
            if short.any():
                mine = owner[short]
                at = np.searchsorted(key, rest[mine] << 44 | rank[mine], side="right") - 1
                sequence[short] = value[at, 0] + (rest[mine] << 44 | rank[mine]) - key[at]
                offset[short] = value[at, 1]
            start = np.where(short, 0, rest[owner] + nth * capacity)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), batch.column(6).flatten(), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    listed = ranked.select("doc_id", "rest", "rank", "full", "full_rank", "n_tokens", "crcs")
    return listed.mapInArrow(place, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
