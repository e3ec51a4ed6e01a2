"""Page images as arrays: thresholds, components, ink, flatness, hashes.

``measured`` runs them over a column of raw gray pixels in Arrow batches.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pictures whose measures a task remembers.
REMEMBERED = 20_000


def gray(image: np.ndarray) -> np.ndarray:
    """8-bit luma of a gray, RGB or RGBA array."""
    image = np.asarray(image)
    if image.ndim == 2:
        return image.astype(np.uint8)
    return np.rint(image[..., :3].astype(np.float64) @ (0.299, 0.587, 0.114)).clip(0, 255).astype(np.uint8)


def otsu(pixels: np.ndarray) -> int:
    """The threshold with the largest variance between ink and paper; 0 for a flat image."""
    count = np.bincount(pixels.ravel(), minlength=256).astype(np.float64)
    dark, total = count.cumsum(), count.sum()
    mass = (count * np.arange(256)).cumsum()
    light = total - dark
    ok = (dark > 0) & (light > 0)
    if not ok.any():
        return 0
    apart = np.zeros(256)
    apart[ok] = dark[ok] * light[ok] * (mass[ok] / dark[ok] - (mass[-1] - mass[ok]) / light[ok]) ** 2
    return int(apart.argmax())


def ink(pixels: np.ndarray) -> tuple[float, bool]:
    """(share of dark pixels, inverted): a mostly dark page with some light on it is white on black."""
    dark = float((pixels < 128).mean()) if pixels.size else 0.0
    return (1 - dark, True) if dark > 0.6 and 1 - dark >= 0.002 else (dark, False)


def flat(pixels: np.ndarray, most_std: float = 12.0, most_spread: float = 25.0) -> bool:
    """Whether a patch has one tone."""
    if not pixels.size:
        return False
    if int(pixels.max()) - int(pixels.min()) < 12:
        return True
    low, high = np.percentile(pixels, (5, 95))
    return bool(pixels.std() < most_std and high - low < most_spread)


def components(mask: np.ndarray, diagonal: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(x1, y1, x2, y2, area) of connected regions in raster order of their first pixel.

    Runs of a row are joined with the runs of the row above that they touch.
    """
    parent: list[int] = []
    runs: list[tuple[int, int, int]] = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    above: list[int] = []
    reach = 1 if diagonal else 0
    for y, row in enumerate(np.asarray(mask, bool)):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
        here, p = [], 0
        for x1, x2 in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            k = len(parent)
            parent.append(k)
            runs.append((y, x1, x2))
            while p < len(above) and runs[above[p]][2] + reach <= x1:
                p += 1
            q = p
            while q < len(above) and runs[above[q]][1] < x2 + reach:
                a, b = root(above[q]), root(k)
                parent[max(a, b)] = min(a, b)
                q += 1
            here.append(k)
        above = here
    found: dict[int, list[int]] = {}
    for k, (y, x1, x2) in enumerate(runs):
        box = found.setdefault(root(k), [x1, y, x2, y + 1, 0])
        box[0], box[2], box[3], box[4] = min(box[0], x1), max(box[2], x2), y + 1, box[4] + x2 - x1
    return [tuple(found[k]) for k in sorted(found)]


def dark_boxes(pixels: np.ndarray, dark: int = 70) -> list[tuple[int, int, int, int]]:
    """Solid near-black boxes of a page image: visible coverings."""
    height, width = pixels.shape
    out = []
    for x1, y1, x2, y2, area in components(pixels < dark):
        w, h = x2 - x1, y2 - y1
        if w >= 8 and h >= 8 and 0.8 <= w / h <= 60 and w * h < 0.4 * width * height and area / (w * h) > 0.92 and flat(pixels[y1 + 1 : y2 - 1, x1 + 1 : x2 - 1]):
            out.append((x1, y1, x2, y2))
    return out


def difference_hash(pixels: np.ndarray, size: int = 8) -> int:
    """64-bit hash of where brightness falls along the rows of a small copy; signed."""
    rows = np.linspace(0, pixels.shape[0], size + 1).astype(int)
    cols = np.linspace(0, pixels.shape[1], size + 2).astype(int)
    sums = np.pad(pixels.astype(np.int64).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    low, right = np.maximum(rows[1:], rows[:-1] + 1), np.maximum(cols[1:], cols[:-1] + 1)
    whole = sums[np.ix_(low, right)] - sums[np.ix_(rows[:-1], right)] - sums[np.ix_(low, cols[:-1])] + sums[np.ix_(rows[:-1], cols[:-1])]
    small = whole / np.outer(low - rows[:-1], right - cols[:-1])
    bits = (small[:, :-1] > small[:, 1:]).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def hamming_similarity(a, b):
    """Share of equal bits of two 64-bit hashes."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def measured(images: DataFrame) -> DataFrame:
    """``images(key, width, height, pixels)`` to (key, threshold, ink, inverted, n_components, n_dark_boxes, dhash); nulls for what can't be read.

    Pictures of equal size and content are measured once in a task, as long as they are among the last ``REMEMBERED`` different ones.
    """

    def run(batches):
        import pyarrow as pa

        known: dict[tuple, tuple] = {}

        for batch in batches:
            out = []
            for key, w, h, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if raw is None or not w or not h or len(raw) != w * h:
                    out.append((key, *[None] * 6))
                    continue
                name = (w, h, blake2b(raw, digest_size=16).digest())
                if name not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    p = np.frombuffer(raw, np.uint8).reshape(h, w)
                    level = otsu(p)
                    known[name] = level, *ink(p), len(components(p <= level)), len(dark_boxes(p)), difference_hash(p)
                out.append((key, *known[name]))
            yield pa.RecordBatch.from_pydict(dict(zip(("key", "threshold", "ink", "inverted", "n_components", "n_dark_boxes", "dhash"), map(list, zip(*out, strict=True)) if out else [[]] * 7, strict=True)), schema=schema())

    def schema():
        import pyarrow as pa

        return pa.schema([("key", pa.string()), ("threshold", pa.int32()), ("ink", pa.float64()), ("inverted", pa.bool_()), ("n_components", pa.int32()), ("n_dark_boxes", pa.int32()), ("dhash", pa.int64())])

    return images.select(F.col("key").cast("string"), "width", "height", "pixels").mapInArrow(run, "key string, threshold int, ink double, inverted boolean, n_components int, n_dark_boxes int, dhash bigint")


def spread(pixels: np.ndarray, threshold: int) -> float:
    """How far apart the mean levels of paper and ink are, on either side of a threshold."""
    count = np.bincount(pixels.ravel(), minlength=256).astype(np.float64)
    levels, dark = np.arange(256), np.arange(256) <= threshold
    if not count[dark].sum() or not count[~dark].sum():
        return 0.0
    return float((levels * count)[~dark].sum() / count[~dark].sum() - (levels * count)[dark].sum() / count[dark].sum())


def profile(pixels: np.ndarray, most: int = 700_000, least_area: int = 4) -> dict:
    """Sizes of a page's connected ink, on a copy of at most ``most`` pixels: count, median height, spread of heights, shares of the largest and the ten largest."""
    inverted = ink(pixels)[1]
    scale = 1
    while pixels.size // scale**2 > most:
        scale += 1
    if scale > 1:
        h, w = (n // scale * scale for n in pixels.shape)
        pixels = pixels[:h, :w].reshape(h // scale, scale, w // scale, scale).mean(axis=(1, 3)).astype(np.uint8)
    mask = pixels >= 128 if inverted else pixels < 128
    found = np.array(components(mask, diagonal=False), np.float64).reshape(-1, 5)
    area, height = found[:, 4], found[:, 3] - found[:, 1]
    if not len(area):
        return {"count": 0, "median_height": 0.0, "height_spread": 0.0, "largest_share": 0.0, "top10_share": 0.0}
    kept = height[area >= least_area]
    middle = float(np.median(kept)) if len(kept) else 0.0
    low, high = np.percentile(kept, (25, 75)) if len(kept) else (0.0, 0.0)
    order = np.sort(area)[::-1] / area.sum()
    return {"count": int((area >= least_area).sum()), "median_height": middle * scale, "height_spread": float((high - low) / middle) if middle else 0.0, "largest_share": float(order[0]), "top10_share": float(order[:10].sum())}


def pictorial(own: dict, dark_share: float) -> bool:
    """Whether ink is a picture rather than text that failed: one part, or ten, have most of it."""
    return dark_share >= 0.02 and (own["largest_share"] >= 0.25 or own["top10_share"] >= 0.5)


def ink_share(pixels: np.ndarray, boxes: list[tuple[float, float, float, float]]) -> tuple[float, tuple[float, float, float, float] | None]:
    """(share of a scan's content under boxes (x, y, w, h), extent of the content): content is ink or box."""
    height, width = pixels.shape
    covered = np.zeros(pixels.shape, bool)
    for x, y, w, h in boxes:
        x1, y1 = (min(n - 1, max(0, int(np.floor(v * n)))) for v, n in ((x, width), (y, height)))
        x2, y2 = (min(n, max(a + 1, int(np.ceil(v * n)))) for v, n, a in ((x + w, width, x1), (y + h, height, y1)))
        covered[y1:y2, x1:x2] = True
    content = covered | (pixels <= otsu(pixels))
    if not content.any():
        return 0.0, None
    rows, cols = np.flatnonzero(content.any(axis=1)), np.flatnonzero(content.any(axis=0))
    extent = cols[0] / width, rows[0] / height, (cols[-1] + 1 - cols[0]) / width, (rows[-1] + 1 - rows[0]) / height
    return float(covered.sum() / content.sum()), tuple(map(float, extent))


def smallest_rendering(variants):
    """The path of the smallest rendering of an array of (width, format, path)."""
    return F.array_min(variants)["path"]


def _middle_of_nine(values: np.ndarray) -> np.ndarray:
    padded = np.pad(values, 1, mode="edge")
    h, w = values.shape
    return np.median(np.stack([padded[a : a + h, b : b + w] for a in range(3) for b in range(3)]), axis=0)


def colourfulness(image: np.ndarray, widest: int = 256) -> float:
    """How much real colour a page has, from 0 to 1: a high percentile of the difference of channels in a small, smoothed copy."""
    image = np.asarray(image)
    if image.ndim == 2:
        return 0.0
    step = max(1, -(-image.shape[1] // widest))
    h, w = (n // step * step for n in image.shape[:2])
    small = image[:h, :w, :3].reshape(h // step, step, w // step, step, 3).mean(axis=(1, 3))
    chroma = np.maximum(np.abs(small[..., 0] - small[..., 1]), np.abs(small[..., 1] - small[..., 2]))
    return float(np.percentile(_middle_of_nine(chroma), 99.9) / 255) if chroma.size else 0.0


def grain(pixels: np.ndarray, tile: int = 512) -> float:
    """Noise in flat parts of a page: the median over four tiles of the median second difference."""
    scores = []
    for k in range(4):
        y, x = (max(0, (n - min(tile, n)) * k // 3) for n in pixels.shape)
        t = pixels[y : y + tile, x : x + tile].astype(np.float32)
        if min(t.shape) < 3:
            scores.append(0.0)
            continue
        across = t[:, :-2] - 2 * t[:, 1:-1] + t[:, 2:]
        scores.append(float(np.median(np.abs(across[:-2] - 2 * across[1:-1] + across[2:]))))
    return float(np.median(scores))
