"""Statutory codes in texts, with their places.

A citation is read by a small parser: bracketed single characters are found first, and each one that can be a number is looked at from
there, to the left for the paragraph and what leads up to it, to the right for the subpart. Prose ("Exemptions 6 and 7(C)") goes through pieces of the text
between separators; a piece that is nothing but a number continues the list before it.

A vocabulary is a parameter: a set of codes. A citation whose last bracket is unknown falls back to its parent: a number keeps the code, a
letter collapses into the parent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, SPACES = "([{", ")]}", 8
# What recognition returns for digits, and the numbers of each statute's codes.
DIGIT = {**{str(d): str(d) for d in range(10)}, "l": "1", "I": "1", "i": "1", "O": "0", "o": "0"}
VOCABULARIES = {
    "us": [*(f"b({n})" for n in range(1, 10)), *(f"b(7)({c})" for c in "ABCDEF"), "j(2)", *(f"k({n})" for n in range(1, 8))],
    "uk": [f"s.{n}" for n in (21, 22, 23, 24, 26, 27, 30, 31, 32, 35, 36, 38, 40, 41, 42, 43)],
    "ca": [f"s.{n}" for n in range(13, 25)],
    "eu": ["art.4(1)", "art.4(1)(a)", "art.4(1)(b)", "art.4(2)", "art.4(3)", "art.4(5)"],
}
SCANNERS = {"us": ("brackets", "prose"), "uk": ("section",), "ca": ("section",), "eu": ("article",)}
GROUP = re.compile(r"[(\[{]\s{0,8}([0-9A-Za-z])\s{0,8}[)\]}]")
LEAD = re.compile(r"(?:5\s{0,8}u\.?\s{0,8}s\.?\s{0,8}c\.?\s{0,8}(?:§+\s{0,8})?)?55\s{0,8}2\s{0,8}$|exemptions?\s{0,8}$|ex\.?\s{0,8}$", re.I)
BREAK = re.compile(r"[,;/&]|\b(?:and|or)\b", re.I)
ITEM = r"\(?\s{0,8}(%s)\s{0,8}\)?(?:\s{0,8}\(\s{0,8}(%s)\s{0,8}\))?"
# How prose cites, by scanner: what opens a list, what an item is, and what must not follow.
PROSE = {
    "prose": (r"(?<![A-Za-z])(?:FOIA\s{1,8})?(?:[Ee]xemptions?|[Ee]x\.)\s{0,8}(?:[Nn]o\.?\s{0,8})?", ITEM % ("[1-9]", "[A-Fa-f]"), "(?![0-9])"),
    "section": (r"(?<![A-Za-z0-9'])(?:[Ss](?i:ections?)|[Ss]\.?)\s{0,8}", ITEM % (r"\d{1,2}", r"\d"), r"(?!\d)(?!\.\d)"),
    "article": (r"(?<![A-Za-z0-9])A(?:rticles?|rts?\.?)\s{0,8}4\s{0,8}", r"\(\s{0,8}([1-9])\s{0,8}\)(?:\s{0,8}\(\s{0,8}([a-cA-C])\s{0,8}\))?", ""),
}
READERS = {name: (re.compile(head + item + end), re.compile(("(?:4\\s{0,8})?" if name == "article" else "") + item)) for name, (head, item, end) in PROSE.items()}


class Hit(NamedTuple):
    start: int
    end: int
    code: str
    source: str


def known(code: str, vocabulary: frozenset[str]) -> str | None:
    """The code, its parent, or nothing."""
    if code in vocabulary:
        return code
    parent, _, tail = code.rpartition("(")
    if parent in vocabulary:
        return code if tail.rstrip(")").isdigit() else parent
    return None


def spelled(scanner: str, number: str, part: str | None) -> str:
    case = {"prose": str.upper, "article": str.lower}.get(scanner, str)
    head = {"prose": f"b({number})", "section": f"s.{number}", "article": f"art.4({number})"}[scanner]
    return head + (f"({case(part)})" if part else "")


class Brackets:
    """Citations made of brackets, such as (b)(7)(C), b(5) and (k)(2)."""

    def __init__(self, text: str):
        self.text, self.groups = text, {m.start(): m for m in GROUP.finditer(text)}

    def left(self, at: int, most: int = SPACES) -> int:
        """Where the white space before a place begins."""
        stop = max(0, at - most)
        while at > stop and self.text[at - 1].isspace():
            at -= 1
        return at

    def next_group(self, at: int):
        """The group that follows a place, behind spaces alone."""
        stop = at
        while stop < len(self.text) and stop - at < SPACES and self.text[stop].isspace():
            stop += 1
        return self.groups.get(stop)

    def paragraph(self, at: int) -> tuple[int, str] | None:
        """(start, letter) of the paragraph that ends before a group at this place."""
        text = self.text
        at = self.left(at)
        if at and text[at - 1] in "-–—":
            at = self.left(at - 1)
        closed = at and text[at - 1] in CLOSE
        if closed:
            at = self.left(at - 1)
        if not at:
            return None
        at -= 1
        letter, start = text[at], self.left(at)
        opened = start and text[start - 1] in OPEN
        at = start - 1 if opened else at
        return (at, letter) if letter in "bB6&" or (letter in "jkJK" and opened and closed) else None

    def __iter__(self) -> Iterator[tuple[int, int, str, str, str, bool]]:
        """(start, end, letter, number, part, read from a 6) of each citation."""
        text = self.text
        for group in self.groups.values():
            number = DIGIT.get(group[1])
            found = self.paragraph(group.start()) if number else None
            if not found:
                continue
            start, letter = found
            private = letter in "jkJK"
            if private and group[1] in "Oo":
                continue
            lead = None if private else LEAD.search(text, max(0, start - 40), start)
            start = lead.start() if lead else start
            before = text[start - 1 : start]
            if (before.isascii() and before.isalnum()) or (not private and before in tuple(OPEN) and text[start - 2 : start - 1].isdigit()):
                continue
            end, part = group.end(), ""
            follow = None if private else self.next_group(end)
            if follow and follow[1] in "ABCDEFabcdef":
                after = self.next_group(follow.end())
                if not (after and after[1] in DIGIT and after[1] != "0"):
                    end, part = follow.end(), follow[1].upper()
            yield start, end, letter.lower(), number, part, letter == "6"


def in_brackets(text: str, vocabulary: frozenset[str], tolerant: bool) -> Iterator[Hit]:
    for start, end, letter, number, part, guessed in Brackets(text):
        if guessed and not tolerant:
            continue
        private = letter in "jk"
        code = known(f"{letter if private else 'b'}({number})" + (f"({part})" if part else ""), vocabulary)
        if code:
            yield Hit(start, end, code, "privacy" if private else "ocr-code" if guessed else "code")


def in_prose(text: str, vocabulary: frozenset[str], scanner: str) -> Iterator[Hit]:
    head, item = READERS[scanner]
    listing, at = False, 0
    for stop in [*(m.span() for m in BREAK.finditer(text)), (len(text), len(text))]:
        piece = text[at : stop[0]]
        named = [(m, code) for m in head.finditer(piece) if (code := known(spelled(scanner, m[1], m[2]), vocabulary))]
        for m, code in named:
            yield Hit(at + m.start(), at + m.end(), code, scanner)
        bare = piece.strip().rstrip(".;:")
        if named:
            listing = True
        elif bare:  # an empty piece between two separators doesn't end a list
            m = item.fullmatch(bare) if listing else None
            listing = m is not None
            code = known(spelled(scanner, m[1], m[2]), vocabulary) if m else None
            if code:
                start = at + piece.index(bare)
                yield Hit(start, start + len(bare), code, "enumeration")
        at = stop[1]


def scan(text: str, jurisdiction: str, vocabulary: frozenset[str], tolerant: bool = False) -> list[Hit]:
    """Citations in order; of overlapping ones the earlier, then the longer one stays."""
    hits: list[Hit] = []
    for scanner in SCANNERS[jurisdiction]:
        hits += in_brackets(text, vocabulary, tolerant) if scanner == "brackets" else in_prose(text, vocabulary, scanner)
    out: list[Hit] = []
    for hit in sorted(hits, key=lambda h: (h.start, -h.end)):
        if not out or hit.start >= out[-1].end:
            out.append(hit)
    return out


def codes(docs: DataFrame, vocabulary: list[str] | None = None, jurisdiction: str = "us") -> DataFrame:
    """(doc_id, code, start, end, raw, source) of every citation in whole texts (doc_id, text); several rows of one doc_id are its pages.

    A 6 is read as b only in documents that cite a code cleanly somewhere, so both readings are made and one is chosen for each document.
    """
    wanted = frozenset(VOCABULARIES[jurisdiction] if vocabulary is None else vocabulary)

    def run(batches):
        import pandas as pd

        for frame in batches:
            out = []
            for key, text in zip(frame.doc_id, frame.text, strict=True):
                strict = scan(text or "", jurisdiction, wanted)
                loose = scan(text or "", jurisdiction, wanted, True) if "6" in (text or "") else strict
                for tolerant, hits in ((False, strict), (True, loose)):
                    out += [(key, tolerant, h.code, h.start, h.end, text[h.start : h.end], h.source) for h in hits]
            yield pd.DataFrame(out, columns=["doc_id", "tolerant", "code", "start", "end", "raw", "source"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, tolerant boolean, code string, start bigint, end bigint, raw string, source string")
    clean = F.bool_or(~F.col("tolerant") & (F.col("source") == "code")).over(Window.partitionBy("doc_id"))
    return read.withColumn("clean", clean).where("tolerant = clean").drop("tolerant", "clean")


def legend(hits: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(code, place, n_documents): codes in the vocabulary's order, unknown ones last."""
    place = F.array_position(F.array(*map(F.lit, vocabulary)), F.col("code"))
    return hits.groupBy("code").agg(F.count_distinct("doc_id").alias("n_documents")).withColumn("place", F.when(place > 0, place).otherwise(len(vocabulary) + 1))


def labelled(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Hits with their gloss of ``labels(code, label)``: a code's own, else its parent's. The vocabulary is bounded and is broadcast."""
    parent = F.regexp_replace("code", r"\([^()]*\)$", "")
    own = F.broadcast(labels.select("code", F.col("label").alias("_own")))
    above = F.broadcast(labels.select(F.col("code").alias("_parent"), F.col("label").alias("_above")))
    return hits.withColumn("_parent", parent).join(own, "code", "left").join(above, "_parent", "left").withColumn("label", F.coalesce("_own", "_above")).drop("_own", "_above", "_parent")


# Where a page's legend stands, how far a code may stand from its box, and when two things are on one line.
FOOTER, HEADER, NEAR, ON_LINE, LEGEND = 0.90, 0.06, 0.05, 0.5, 3


def associated(hits: DataFrame, boxes: DataFrame, aspect: float = 612 / 792) -> DataFrame:
    """(doc_id, page, hid, rid) of codes on a page (hid, x, y, w, h) and the box (rid, ...) that each explains; rid is null for codes of the whole page.

    One box on the code's line is meant, however far; of several the nearest within 0.05 page heights, or none; with none on the line the nearest
    within that. In the header and footer lines say nothing, and three codes or more there are a legend.
    """
    page = ["doc_id", "page"]
    band = (F.col("y") >= FOOTER) | (F.col("y") + F.col("h") <= HEADER)
    codes_ = hits.withColumn("band", band).withColumn("legend", F.col("band") & (F.sum(F.col("band").cast("int")).over(Window.partitionBy(*page)) >= LEGEND))
    b = boxes.select(*page, "rid", *(F.col(c).alias(f"b_{c}") for c in "xywh"))
    apart = lambda at, size: F.greatest(F.lit(0.0), F.col(f"b_{at}") - F.col(at) - F.col(size), F.col(at) - F.col(f"b_{at}") - F.col(f"b_{size}"))
    gap = F.round(F.sqrt(F.pow(apart("x", "w") * aspect, F.lit(2)) + F.pow(apart("y", "h"), F.lit(2))), 9)
    both = F.least(F.col("y") + F.col("h"), F.col("b_y") + F.col("b_h")) - F.greatest("y", "b_y")
    line = (both >= ON_LINE * F.least("h", "b_h")) & (F.least("h", "b_h") > 0) & ~F.col("band")
    pairs = codes_.where("not legend").join(b, page).withColumns({"gap": gap, "line": line}).where(F.col("line") | (F.col("gap") <= NEAR))
    own = Window.partitionBy(*page, "hid")
    pairs = pairs.withColumn("n_line", F.sum(F.col("line").cast("int")).over(own))
    may = pairs.where(F.when(F.col("n_line") == 1, F.col("line")).when(F.col("n_line") > 1, F.col("line") & (F.col("gap") <= NEAR)).otherwise(F.col("gap") <= NEAR))
    best = may.withColumn("k", F.row_number().over(own.orderBy("gap", "rid"))).where("k = 1").select(*page, "hid", "rid")
    return hits.select(*page, "hid").join(best, [*page, "hid"], "left")
