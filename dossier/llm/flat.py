"""Whole-batch text kernels: the strings of an Arrow batch seen as one byte buffer.

Every kernel works on ``(buf, off)``: the concatenated UTF-8 bytes and the row offsets, so the
cost is a few array passes for each byte and no Python step for each word. All hashing is done
with fixed constants; equal bytes give equal values on every executor and at every run.
"""

from __future__ import annotations

import numpy as np

KEY = b"dossier"
#: Bytes of a batch that are worked on at once; a kernel needs some hundred times as much.
SLICE_BYTES = 256 << 10
#: Bytes of an Arrow batch at most, in the JVM and in a worker.
BATCH_BYTES = 2 << 20


def ship() -> None:
    """Send this package's functions to Python workers by value, so that executors need no copy of it.

    Arrow batches of the session are held to ``BATCH_BYTES``, as rows may be long; a smaller limit of its own stays.
    """
    import sys

    from pyspark import cloudpickle
    from pyspark.sql import SparkSession

    conf, limit = SparkSession.active().conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(limit).removesuffix("b")) <= BATCH_BYTES:
        conf.set(limit, str(BATCH_BYTES))

    package = __name__.rpartition(".")[0]
    for name, module in list(sys.modules.items()):
        if name == package or name.startswith(package + "."):
            cloudpickle.register_pickle_by_value(module)


def released(kernel):
    """The mapInArrow kernel, giving freed memory back when a task ends, as a worker process is kept for later tasks."""

    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            release()

    return run


def release() -> None:
    import ctypes
    from contextlib import suppress

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def columns(batch, name: str):
    """The string column as ``(buf, off)``; a null counts as the empty string."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    base, end = int(off[0]), int(off[-1])
    buf = np.frombuffer(data, dtype=np.uint8, count=end - base, offset=base) if end > base else np.zeros(0, np.uint8)
    return buf, off - base


def slices(off: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges of at most ``most`` bytes each; one longer row stands alone."""
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield at, to
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def blocks(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, with zeros behind the end."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def _block(view: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Blocks at these places, of which only ``left`` bytes count."""
    spare = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)
    return view[at] << spare


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes, whatever stands around them. Spans of up to eight bytes and one length never collide."""
    from hashlib import blake2b

    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    view = blocks(buf)
    own = np.flatnonzero((size > 0) & (size <= 64))
    for k in range(0, 64, 8):
        own = own[size[own] > k]
        if not len(own):
            break
        with np.errstate(over="ignore"):
            out[own] = mix((out[own] ^ _block(view, start[own] + k, size[own] - k)) + np.uint64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(size > 64):
        out[k] = int.from_bytes(blake2b(buf[start[k] : end[k]].tobytes(), digest_size=8, key=KEY).digest(), "little")
    return out


def same_bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span has the same bytes as the span of its size that starts at ``other``."""
    view, size = blocks(buf), end - start
    out, own, k = np.ones(len(start), bool), np.arange(len(start)), 0
    while len(own):
        out[own] &= _block(view, start[own] + k, size[own] - k) == _block(view, other[own] + k, size[own] - k)
        k += 8
        own = own[size[own] > k]
    return out


def names(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """128-bit keyed digests of spans of bytes or of hashes, which stand for the spans themselves."""
    from hashlib import blake2b

    raw, unit = memoryview(np.ascontiguousarray(values)).cast("B"), values.itemsize
    return [blake2b(raw[s:e], digest_size=16, key=KEY).digest() for s, e in zip((start * unit).tolist(), (end * unit).tolist(), strict=True)]


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[buf]


def words(buf: np.ndarray, off: np.ndarray):
    """Maximal runs of bytes outside 0x20 and 0x09-0x0D, which never cross rows.

    Returns (start, end, row) of each word, in order.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = np.ones(256, bool)
    solid[[9, 10, 11, 12, 13, 32]] = False
    inside = solid[buf]
    edge = np.empty(n, bool)
    edge[0] = False
    edge[1:] = inside[:-1]
    breaks = off[1:-1]
    edge[breaks[breaks < n]] = False
    start = np.flatnonzero(inside & ~edge)
    last = np.empty(n, bool)
    last[:-1] = inside[1:]
    last[-1] = False
    ends = breaks[breaks > 0] - 1
    last[ends] = False
    end = np.flatnonzero(inside & ~last) + 1
    row = np.searchsorted(off, start, side="right") - 1
    return start, end, row


def shingles(buf: np.ndarray, off: np.ndarray, width: int):
    """Hashes of the distinct word shingles of each row, ascending, as (values, row offsets).

    A row with fewer than ``width`` words has its whole sequence as one shingle; one without words has none.
    """
    start, end, row = words(buf, off)
    rows = len(off) - 1
    count = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(count)))
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    token = span_hash(lowered(buf), start, end)
    weights = [np.uint64(mix(np.array([k + 1], np.uint64))[0] | np.uint64(1)) for k in range(width)]
    with np.errstate(over="ignore"):
        long_rows = np.flatnonzero(count >= width)
        windows = count[long_rows] - width + 1
        at = np.repeat(first[long_rows] - np.concatenate(([0], np.cumsum(windows)[:-1])), windows) + np.arange(windows.sum())
        full = np.zeros(len(at), np.uint64)
        for k in range(width):
            full += mix(token[at + k] + np.uint64(k)) * weights[k]
        full = mix(full)
        brief = np.flatnonzero((count > 0) & (count < width))
        less = np.zeros(len(brief), np.uint64)
        for k in range(width - 1):
            has = count[brief] > k
            less[has] += mix(token[first[brief[has]] + k] + np.uint64(k)) * weights[k]
        less = mix(less + np.uint64(0xA5A5A5A5) + count[brief].astype(np.uint64))
    sizes = np.zeros(rows, np.int64)
    sizes[long_rows], sizes[brief] = windows, 1
    at = np.concatenate(([0], np.cumsum(sizes)))
    value = np.empty(at[-1], np.uint64)
    is_full = np.repeat(count >= width, sizes)
    value[is_full], value[~is_full] = full, less
    for i in long_rows:
        value[at[i] : at[i + 1]].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = value[1:] != value[:-1]
    keep[at[:-1][sizes > 0]] = True
    return value[keep], np.concatenate(([0], np.cumsum(keep)))[at]
