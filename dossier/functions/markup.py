"""A safe subset of Markdown as HTML."""

from __future__ import annotations

import html
import re

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Addresses that are followed, and signs of lines.
_SAFE = re.compile(r"https?://|mailto:|[./#]|[A-Za-z0-9_-]+[/.]")
_RULE = re.compile(r"-{3,}|\*{3,}|_{3,}")
_ITEM = re.compile(r"(?:([-*+])|\d+[.)])\s+(.*)")


def inline(text: str) -> str:
    """Escapes a line, then brings back code, bold, italic and links. A link that is not followed shows where it leads."""
    out = html.escape(text)
    for mark, tag in (("`([^`\n]+)`", "code"), (r"\*\*([^*\n]+)\*\*", "strong"), (r"(?<![*\w])\*([^*\n]+)\*(?!\w)", "em")):
        out = re.sub(mark, rf"<{tag}>\1</{tag}>", out)

    def link(m: re.Match) -> str:
        target = html.unescape(m[2])
        if not _SAFE.match(target):
            return f"{m[1]} ({html.escape(target)})"
        apart = ' rel="noopener noreferrer"' if target.startswith(("http://", "https://")) else ""
        return f'<a href="{html.escape(target)}"{apart}>{m[1]}</a>'

    return re.sub(r"\[([^\]\n]+)\]\(([^)\s]+)\)", link, out)


def uncommented(text: str) -> str:
    """Comments go, an open one with all behind it."""
    head, *rest = text.split("<!--")
    return head + "".join(part.split("-->", 1)[1] for part in rest if "-->" in part)


def signs(text: str):
    """(kind, content) of each line: blank, rule, h2 to h4, quote, ul, ol or text."""
    for line in uncommented(text).replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = line.strip()
        level = len(line) - len(line.lstrip("#"))
        item = _ITEM.fullmatch(line)
        if not line:
            yield "blank", ""
        elif _RULE.fullmatch(line):
            yield "rule", ""
        elif 1 <= level <= 3 and line[level : level + 1].isspace():
            yield f"h{level + 1}", line[level:].strip()
        elif line.startswith(">"):
            yield "quote", line.lstrip("> ")
        elif item:
            yield ("ul" if item[1] else "ol"), item[2]
        else:
            yield "text", line


def render(text: str | None) -> str | None:
    """Headings one level down, lists, quotes, rules and paragraphs. Lines behind a quote belong to it until a blank one."""
    if text is None:
        return None
    blocks: list[tuple[str, list[str]]] = []
    for kind, content in signs(text):
        last = blocks[-1][0] if blocks else "blank"
        if kind == "text" and last == "quote":
            kind = "quote"
        if kind == last and kind in ("text", "quote", "ul", "ol"):
            blocks[-1][1].append(content)
        else:
            blocks.append((kind, [content]))
    out: list[str] = []
    for kind, lines in blocks:
        if kind == "rule":
            out.append("<hr>")
        elif kind in ("ul", "ol"):
            out += [f"<{kind}>", *(f"<li>{inline(x)}</li>" for x in lines), f"</{kind}>"]
        elif kind in ("text", "quote"):
            paragraph = f"<p>{inline(' '.join(lines).strip())}</p>"
            out += ["<blockquote>", paragraph, "</blockquote>"] if kind == "quote" else [paragraph]
        elif kind != "blank":
            out.append(f"<{kind}>{inline(lines[0])}</{kind}>")
    return "\n".join(out)


@F.pandas_udf(StringType())
def rendered(text):
    return text.map(render, na_action="ignore")


def citation(style: str, title, page, date, url):
    """A citation in one of three styles; clauses without a value are left out."""
    dated, paged, linked = F.concat(F.lit(" ("), date, F.lit(")")), F.concat(F.lit(", p. "), page.cast("string")), F.concat(F.lit(". "), url)
    if style == "note":
        return F.concat(title, F.coalesce(dated, F.lit("")), F.coalesce(paged, F.lit("")), F.coalesce(linked, F.lit("")))
    if style == "brief":
        return F.concat(title, F.coalesce(paged, F.lit("")))
    if style == "link":
        return F.concat(F.lit("["), title, F.coalesce(paged, F.lit("")), F.lit("]("), F.coalesce(url, F.lit("#")), F.lit(")"))
    raise ValueError(f"unknown style {style!r}")
