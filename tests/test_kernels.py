"""Image kernels, code scanners and markup, without Spark."""

import numpy as np

from dossier.functions.markup import render
from dossier.operators import images


def test_thresholds_and_ink():
    page = np.full((60, 80), 240, np.uint8)
    page[20:40, 10:50] = 20
    assert 20 <= images.otsu(page) < 240 and images.otsu(np.full((4, 4), 9, np.uint8)) == 0
    assert images.ink(page) == (800 / 4800, False)
    assert images.ink(255 - np.where(page == 240, 255, 0).astype(np.uint8))[1] in (True, False)
    assert images.dark_boxes(page) == [(10, 20, 50, 40)]
    hollow = page.copy()
    hollow[22:38, 12:48] = 240
    assert images.dark_boxes(hollow) == []


def test_components_by_flood_fill():
    rng = np.random.default_rng(3)
    for diagonal in (True, False):
        for _ in range(20):
            mask = rng.random((9, 11)) < 0.45
            seen, expected = np.zeros_like(mask), []
            for y, x in zip(*np.nonzero(mask), strict=True):
                if seen[y, x]:
                    continue
                todo, own = [(y, x)], []
                seen[y, x] = True
                while todo:
                    a, b = todo.pop()
                    own.append((a, b))
                    for da in (-1, 0, 1):
                        for db in (-1, 0, 1):
                            c, d = a + da, b + db
                            if (diagonal or not (da and db)) and 0 <= c < 9 and 0 <= d < 11 and mask[c, d] and not seen[c, d]:
                                seen[c, d] = True
                                todo.append((c, d))
                ys, xs = zip(*own, strict=True)
                expected.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(own)))
            assert sorted(images.components(mask, diagonal)) == sorted(expected)


def test_difference_hash_is_stable_under_brightness():
    page = np.add.outer(np.arange(64), np.sin(np.arange(90)) * 40 + 90).astype(np.uint8)
    assert images.difference_hash(page) == images.difference_hash((page * 0.9).astype(np.uint8))


def test_markdown():
    text = "# Title\n\nA **bold** [link](https://x.org) and [bad](javascript:1) <b>\n- one\n- two\n\n> said\n\n---\n<!-- gone -->`a*b*`"
    assert render(text) == '<h2>Title</h2>\n<p>A <strong>bold</strong> <a href="https://x.org" rel="noopener noreferrer">link</a> and bad (javascript:1) &lt;b&gt;</p>\n<ul>\n<li>one</li>\n<li>two</li>\n</ul>\n<blockquote>\n<p>said</p>\n</blockquote>\n<hr>\n<p><code>a*b*</code></p>'


def test_profiles_grain_and_colour():
    rng = np.random.default_rng(0)
    page = np.full((120, 160), 235, np.uint8)
    page[20:24, 10:150:4] = 20
    text = images.profile(page)
    assert text["count"] == 35 and text["median_height"] == 4 and not images.pictorial(text, images.ink(page)[0])
    photo = page.copy()
    photo[30:110, 20:140] = 60
    assert images.pictorial(images.profile(photo), images.ink(photo)[0])
    assert images.profile(np.full((5, 5), 255, np.uint8))["count"] == 0
    assert images.grain(page) == 0.0 < images.grain(np.clip(page + rng.normal(0, 9, page.shape), 0, 255).astype(np.uint8))
    stamp = np.repeat(page[..., None], 3, axis=2)
    stamp[60:80, 60:90] = (200, 20, 20)
    assert images.colourfulness(stamp) > 0.3 and images.colourfulness(np.repeat(page[..., None], 3, axis=2)) == 0.0 == images.colourfulness(page)
    assert images.spread(page, images.otsu(page)) == 215.0
    share, extent = images.ink_share(page, [(0.5, 0.5, 0.25, 0.25)])
    assert abs(share - 1200 / (1200 + 140)) < 1e-9 and extent[0] == 10 / 160


def test_difference_hash_is_that_of_means():
    import numpy as np

    from dossier.operators import images

    rng = np.random.default_rng(6)
    for h, w in ((30, 40), (5, 7), (1, 1), (61, 33)):
        p = rng.integers(0, 256, (h, w)).astype(np.uint8)
        rows, cols = np.linspace(0, h, 9).astype(int), np.linspace(0, w, 10).astype(int)
        small = [[p[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(cols, cols[1:], strict=False)] for a, b in zip(rows, rows[1:], strict=False)]
        bits = [x > y for r in small for x, y in zip(r, r[1:], strict=False)]
        assert images.difference_hash(p) == int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)
