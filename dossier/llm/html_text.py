"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks. What the elements around a block say, and a linear classifier over its words, links and tag, give what it
costs to call the block content or boilerplate; these costs are the capacities to the two terminals. The classifier is fitted on blocks of a bounded
sample of the pages themselves, those whose elements leave no doubt, and stays near its starting weights where they are few. Blocks that follow each
other, and blocks that follow each other in one element with others between them, are joined by edges whose capacity grows with how near they
are in the element tree. The maximum flow from one terminal to the other leaves a cut of least cost, and the blocks on its content side are the text.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import flat
from dossier.llm.common import sampled

#: Pages that the classifier is fitted on at most, chosen by digest, and blocks of each.
SAMPLE, SAMPLE_BLOCKS = 1000, 64

# Element names of HTML, and common words in names of page parts.
RAW = frozenset("script style template title textarea noscript iframe object audio video canvas select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option button label".split()
)
ENDS_P = BLOCK - {"button", "label", "option", "html", "body"}
PART_OF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NOT_TEXT = frozenset("nav aside form footer menu dialog button label fieldset".split())
ASIDE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs side sidebar widget widgets foot footer head header masthead topbar banner ad ads advert adverts advertisement advertising adsense sponsor sponsors promo "
    "promotion cookie cookies consent gdpr notice notices alert alerts warning popup modal overlay newsletter subscribe subscription signup login social share sharing comment comments disqus reply replies "
    "respond discussion pagination pager paging tag tags copyright legal disclaimer search form toolbar hidden skip teaser outbrain taboola contentinfo complementary".split()
)
ANYWHERE = frozenset("related recommended recommendations popular trending sponsored promoted similar".split())
TEXT = frozenset("article main content post entry story body text hentry prose articlebody maincontent".split())
#: Words at the end of a name that say nothing by themselves: the word before them does.
HOLDER = frozenset("list item items box wrapper wrap container section block area slot unit bar panel row col column inner outer content body text link links title group holder module region top bottom left right main".split())

NAMED = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|data-role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME = re.compile(r"[A-Za-z][^\s/>]*")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Starting weights of the classifier: constant, words, closing mark, running text's tags, mostly links, copyright line, commas.
START = np.array([-0.8, 1.0, 0.8, 0.8, -4.0, -3.0, 0.3])


def said_by_name(name: str) -> int:
    """What one class or id says: -1 page furniture, 1 text, 0 nothing."""
    parts = [p.lower() for p in PART.findall(name)]
    if any(p in ANYWHERE for p in parts):
        return -1
    if len(parts) == 1:
        return -1 if parts[0] in ASIDE else 1 if parts[0] in TEXT else 0
    while len(parts) > 1 and parts[-1] in HOLDER:
        if parts[-2] in TEXT or (parts[-1] in TEXT and parts[-2] not in ASIDE):
            return 1
        parts.pop()
    return -1 if parts and parts[-1] in ASIDE else 1 if parts and parts[-1] in TEXT else 0


def hint(tag: str, attributes: str, inside_article: bool) -> float:
    """What an element says of the text in it: negative for boilerplate. Names that contradict each other say nothing."""
    if tag in NOT_TEXT or (tag == "header" and not inside_article) or (attributes and UNSEEN.search(attributes)):
        return -6.0
    names = {said_by_name(n) for found in NAMED.findall(attributes) for n in "".join(found).split()} if attributes else set()
    if -1 in names and 1 not in names and tag not in ("html", "body", "main"):
        return -6.0
    if tag in ("article", "main"):
        return 4.0
    return 2.0 if 1 in names and -1 not in names else 0.0


class Block:
    __slots__ = ("path", "tag", "good", "bad", "text", "linked")

    def __init__(self, path, tag, good, bad):
        self.path, self.tag, self.good, self.bad, self.text, self.linked = path, tag, good, bad, [], 0


def tokens(page: str):
    """("text", text), ("open", tag, attributes) and ("close", tag) of a page, each character read once or twice."""
    at, size, last = 0, len(page), page.rfind(">")
    unclosed: set[str] = set()
    while at < size:
        low = page.find("<", at)
        if low < 0 or low > last:
            yield "text", page[at:], ""
            return
        if low > at:
            yield "text", page[at:low], ""
        if page.startswith("<!--", low):
            end = page.find("-->", low + 4)
            if end < 0:
                return
            at = end + 3
            continue
        close = page.startswith("</", low)
        name = NAME.match(page, low + 1 + close)
        if name is None:
            if close or page.startswith(("<!", "<?"), low):
                at = page.find(">", low) + 1
            else:
                yield "text", "<", ""
                at = low + 1
            continue
        end = name.end()
        while True:  # to the first > outside quotes
            stop = page.find(">", end)
            if stop < 0:
                stop = page.find(">", name.end())
                break
            quote = min((k for k in (page.find(q, end, stop) for q in "\"'" if q not in unclosed) if k >= 0), default=-1)
            if quote < 0:
                break
            other = page.find(page[quote], quote + 1)
            if other < 0:
                unclosed.add(page[quote])
            else:
                end = other + 1
        tag = name[0].lower()
        yield ("close" if close else "open"), tag, page[name.end() : stop]
        at = stop + 1
        if not close and tag in RAW and not page[stop - 1] == "/":
            low = page.lower().find(f"</{tag}", at) if size < 4096 else _find_close(page, tag, at)
            if low < 0:
                return
            at = page.find(">", low) + 1 or size


def _find_close(page: str, tag: str, at: int) -> int:
    found = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
    return found.start() if found else -1


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; each knows the elements around it and how much of it is links."""
    out: list[Block] = []
    stack: list[tuple] = []  # (tag, number, best hint, worst hint, in a link)
    path: list[int] = []  # numbers of the block elements on the stack
    open_: dict[str, int] = {}  # how many elements of each tag are on the stack
    now, count = None, 0

    def pop(k: int):
        nonlocal now
        for tag, *_ in stack[k:]:
            open_[tag] -= 1
            if tag in BLOCK:
                path.pop()
                now = None
        del stack[k:]

    for kind, tag, attributes in tokens(page):
        if kind == "text":
            text = html.unescape(tag)
            if now is None:
                if not text or text.isspace():
                    continue
                _, _, good, bad, _ = stack[-1] if stack else ("", 0, 0.0, 0.0, False)
                own = next((s[0] for s in reversed(stack) if s[0] in BLOCK), "")
                now = Block(tuple(path[-12:]), own, good, bad)
                out.append(now)
            now.text.append(text)
            if stack and stack[-1][4]:
                now.linked += len(text)
            continue
        if kind == "close":
            if tag in BLOCK:
                now = None
            if open_.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop(k)
            continue
        if tag in RAW or (tag in VOID and tag not in ("br", "hr")) or tag == "head":
            continue
        if tag == "br":
            if now is not None:
                now.text.append(" ")
            continue
        if tag in BLOCK:
            now = None
            if tag == "hr":
                continue
            if tag in ENDS_P and open_.get("p"):
                k = len(stack) - 1
                while k >= 0 and stack[k][0] not in BLOCK:
                    k -= 1
                if k >= 0 and stack[k][0] == "p":
                    pop(k)
            same = PART_OF.get(tag)
            if same and any(open_.get(t) for t in same):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in same:
                        pop(k)
                        if tag != "tr":
                            break
                    elif stack[k][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                        break
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        count += 1
        _, _, good, bad, link = stack[-1] if stack else ("", 0, 0.0, 0.0, False)
        own = hint(tag, attributes.rstrip("/"), good >= 4.0)
        if tag in BLOCK:
            path.append(count)
        stack.append((tag, count, max(good, own), min(bad, own), link or tag == "a"))
        open_[tag] = open_.get(tag, 0) + 1
    return out


def measured(block: Block, text: str) -> np.ndarray:
    """What the classifier sees of a block: none of it depends on the elements further out."""
    words = text.count(" ") + 1
    return np.array(
        [1.0, min(words, 40) / 12, text[-1] in ".!?…:;\"'”»)", block.tag in ("", "p", "h1", "blockquote", "pre"), block.linked > 0.5 * len(text), text[0] == "©" or text[:9].lower() == "copyright", min(1.0, 8 * text.count(",") / words)]
    )


def fitted(x: np.ndarray, y: np.ndarray, hold: float = 200.0) -> np.ndarray:
    """Weights of a logistic regression that ``hold`` keeps near the starting ones, by Newton steps."""
    w = START.copy()
    for _ in range(20 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold * np.eye(len(w)), x.T @ (p - y) + hold * (w - START))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def worth(block: Block, text: str, weights: np.ndarray = START) -> float:
    """Log-odds that a block is content: what being called boilerplate would cost, or, negative, content."""
    x = measured(block, text)
    if block.good >= 4.0 and text.count(" ") >= 11:
        x[4] = 0.0  # a sentence of links in an article is text
    return float(x @ weights) + (block.bad if block.bad < 0 else block.good)  # furniture stays so inside the article, too


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a least cut.

    A positive gain is the capacity from the source, a negative one that to the sink. Each round finds how far every node is from the source
    and fills all shortest ways at once.
    """
    n = len(gain)
    source, sink = n, n + 1
    head, room, out = [], [], [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float):
        out[a].append(len(head))
        head.append(b)
        room.append(there)
        out[b].append(len(head))
        head.append(a)
        room.append(back)

    for k, g in enumerate(gain):
        join(*((source, k) if g > 0 else (k, sink)), abs(g), 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        far = [-1] * (n + 2)
        far[source], level = 0, [source]
        while level and far[sink] < 0:
            after = []
            for a in level:
                for e in out[a]:
                    b = head[e]
                    if far[b] < 0 and room[e] > 1e-9:
                        far[b] = far[a] + 1
                        after.append(b)
            level = after
        if far[sink] < 0:
            return [far[k] >= 0 for k in range(n)]
        turn, way, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                flow = min(room[e] for e in way)
                for e in way:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(way) if room[e] <= 1e-9)
                a = head[way[k] ^ 1]
                del way[k:]
                continue
            for t in range(turn[a], len(out[a])):
                e = out[a][t]
                if room[e] > 1e-9 and far[head[e]] == far[a] + 1:
                    turn[a] = t
                    way.append(e)
                    a = head[e]
                    break
            else:
                turn[a] = len(out[a])
                if a == source:
                    break
                e = way.pop()
                a = head[e ^ 1]
                turn[a] += 1


def shared(a: tuple, b: tuple) -> float:
    """How much of two paths through the element tree is one path."""
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return same / max(len(a), len(b), 1)


def spaced(page: str) -> list[tuple[Block, str]]:
    found = [(b, " ".join("".join(b.text).split())) for b in blocks(page)]
    return [(b, t) for b, t in found if t]


def main_text(page: str | None, weights: np.ndarray = START) -> str:
    """The page's main text: one line for each block, in page order."""
    found = spaced(page or "")
    if not found:
        return ""
    # blocks side by side in one element, with the same signs, are one node
    nodes: list[list[int]] = []
    gain: list[float] = []
    for k, (b, t) in enumerate(found):
        g = worth(b, t, weights)
        last = found[k - 1][0] if k else None
        if last is not None and last.path[:-1] == b.path[:-1] and (last.good, last.bad) == (b.good, b.bad) and (gain[-1] > 0) == (g > 0):
            nodes[-1].append(k)
            gain[-1] += g
        else:
            nodes.append([k])
            gain.append(g)
    edges, before = [], {}

    def edge(i: int, j: int, weight: float):
        a, b = found[nodes[i][-1]][0], found[nodes[j][0]][0]
        edges.append((i, j, weight * (0.3 + 1.5 * shared(a.path, b.path) ** 2) * (1.0 if (a.bad < 0) == (b.bad < 0) else 0.15)))

    for k in range(len(nodes)):
        if k:
            edge(k - 1, k, 1.0)
        home = found[nodes[k][0]][0].path[:-1]
        if before.get(home, k - 1) < k - 1:
            edge(before[home], k, 0.5)  # the next one in the same element, with others between
        before[home] = k
    kept = minimum_cut(gain, edges)
    return "\n".join(found[k][1] for node, keep in zip(nodes, kept, strict=True) if keep for k in node)


def _weights(pages: DataFrame, id_col: str, html_col: str) -> np.ndarray:
    """The classifier, fitted on blocks of sample pages that are surely text (in an article, nothing against it) or surely furniture."""
    told = F.concat_ws(":", F.col("id").cast("string"), F.xxhash64("html").cast("string"))
    chosen = sampled(pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(html_col).alias("html")), F.md5(told), SAMPLE).select("html")

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = []
            for page in frame.html:
                sure = [(b, t) for b, t in spaced(page) if b.bad < 0 or b.good >= 4.0]
                for b, t in sure[:: max(1, len(sure) // SAMPLE_BLOCKS)]:
                    rows.append([float(b.bad >= 0), *measured(b, t)])
            yield pd.DataFrame({"row": rows})

    rows = np.array([r["row"] for r in chosen.mapInPandas(run, "row array<double>").collect()], np.float64).reshape(-1, 1 + len(START))
    rows = rows[np.lexsort(rows.T[::-1])]  # the order of rows must not matter
    return fitted(rows[:, 1:], rows[:, 0])


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``.

    Character references are decoded, white space in a block is one space, blocks are joined by newlines. A null or empty page, or one without main text, has the
    empty text. Repeated rows are extracted alike. Other columns are not read; an empty table gives an empty result. A page's cost grows with its length, not
    faster.
    """
    flat.ship()
    weights = _weights(pages, id_col, html_col)

    @F.pandas_udf("string")
    def text(page):
        return page.map(lambda p: main_text(p, weights))

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
