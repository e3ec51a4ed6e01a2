"""PDF files as tables: pages, glyphs and filled rectangles in the order in which they are painted, and metadata.

A small reader of the format: objects, object streams, deflated streams, the page tree, and the operators that paint text and paths. Fonts are read as far
as widths and character maps go. What it can't read (encrypted files, other filters) is an error in a column, never a failed task.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# White space and delimiters of the format, and the metadata keys that are kept.
_SPACE, _MARKS = b"\0\t\n\f\r ", b"()<>[]{}/%"
META = {"Title": "title", "Author": "author", "Subject": "subject", "Keywords": "keywords", "Creator": "creator", "Producer": "producer", "CreationDate": "created", "ModDate": "modified"}
_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b")
LETTER = [0.0, 0.0, 612.0, 792.0]


class Name(str):
    pass


class Ref(int):
    pass


class Word(bytes):
    """An operator or keyword."""


class Lexer:
    """Values of a stretch of PDF, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        data, n = self.data, len(self.data)
        while self.at < n:
            if data[self.at] in _SPACE:
                self.at += 1
            elif data[self.at] == 0x25:
                ends = [k for k in (data.find(b"\n", self.at), data.find(b"\r", self.at)) if k >= 0]
                self.at = min(ends, default=n)
            else:
                return

    def text(self) -> bytes:
        """A literal string, behind its opening bracket."""
        out, depth, data = bytearray(), 1, self.data
        plain = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}
        while self.at < len(data):
            c = data[self.at]
            self.at += 1
            if c == 0x5C and self.at < len(data):
                e = data[self.at]
                digits = re.compile(rb"[0-7]{1,3}").match(data, self.at)
                if digits:
                    out.append(int(digits[0], 8) & 255)
                    self.at = digits.end()
                    continue
                self.at += 1
                if e not in b"\r\n":
                    out.append(plain.get(e, e))
                continue
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                break
            out.append(c)
        return bytes(out)

    def value(self, depth: int = 0):
        """The next value; None at the end. Values nested deeper than files have them end the stretch."""
        self.skip()
        data = self.data
        if self.at >= len(data) or depth > 60:
            return None
        c = data[self.at : self.at + 1]
        if c == b"(":
            self.at += 1
            return self.text()
        if data.startswith(b"<<", self.at):
            self.at += 2
            out = {}
            while True:
                key = self.value(depth + 1)
                if not isinstance(key, Name):
                    return out
                out[str(key)] = self.value(depth + 1)
        if c == b"<":
            end = data.find(b">", self.at)
            raw = re.sub(rb"[^0-9A-Fa-f]", b"", data[self.at + 1 : end if end >= 0 else len(data)])
            self.at = end + 1 if end >= 0 else len(data)
            return bytes.fromhex((raw + b"0" * (len(raw) % 2)).decode())
        if c in (b"[", b"{"):
            self.at += 1
            out = []
            while True:
                item = self.value(depth + 1)
                if item is None or (isinstance(item, Word) and item in (b"]", b"}")):
                    return out
                if isinstance(item, Word) and item == b"R" and len(out) > 1:
                    out[-2:] = [Ref(out[-2])]
                else:
                    out.append(item)
        if data.startswith(b">>", self.at):
            self.at += 2
            return Word(b">>")
        if c in (b"]", b"}", b")", b">"):
            self.at += 1
            return Word(c)
        end = self.at + 1
        while end < len(data) and data[end] not in _SPACE and data[end] not in _MARKS:
            end += 1
        token, self.at = data[self.at : end], end
        if c == b"/":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), token[1:]).decode("latin-1"))
        if re.fullmatch(rb"[+-]?\d+", token):
            ahead = re.compile(rb"\s+(\d+)\s+R(?![A-Za-z0-9])").match(data, self.at)
            if ahead and token.isdigit():
                self.at = ahead.end()
                return Ref(int(token))
            return int(token)
        if re.fullmatch(rb"[+-]?(?:\d+\.\d*|\.\d+)", token):
            return float(token)
        return {b"true": True, b"false": False}.get(token, Word(token))


class Pdf:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("no PDF")
        self.data, self.at, self.held = data, {}, {}
        for m in _OBJECT.finditer(data):
            self.at[int(m[1])] = m.end()  # the last one of a number counts
        self.trailer: dict = {}
        for m in re.finditer(rb"\btrailer\b", data):
            found = Lexer(data, m.end()).value()
            self.trailer |= found if isinstance(found, dict) else {}
        for number in list(self.at):
            head = self.get(number)
            kind = head.get("Type") if isinstance(head, dict) else None
            if kind == "XRef":
                self.trailer |= {k: v for k, v in head.items() if k in ("Root", "Info", "Encrypt")}
            elif kind == "ObjStm":
                self.unpack(number)
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted")

    def get(self, number: int):
        """The object of a number."""
        if number not in self.held:
            self.held[number] = Lexer(self.data, self.at[number]).value() if number in self.at else None
        return self.held[number]

    def of(self, value):
        """What a reference stands for; other values stand for themselves."""
        return self.get(int(value)) if isinstance(value, Ref) else value

    def unpack(self, number: int) -> None:
        head, body = self.get(number), self.stream(number)
        lexer, first = Lexer(body), self.of(head.get("First")) or 0
        pairs = [(lexer.value(), lexer.value()) for _ in range(min(int(self.of(head.get("N")) or 0), 100_000))]
        for own, offset in pairs:
            if isinstance(own, int) and isinstance(offset, int) and own not in self.at:
                self.held[own] = Lexer(body, first + offset).value()

    def stream(self, number: int) -> bytes:
        head = self.get(number) if number in self.at else None
        if not isinstance(head, dict):
            return b""
        lexer = Lexer(self.data, self.at[number])
        lexer.value()
        start = self.data.find(b"stream", lexer.at)
        if start < 0:
            return b""
        start += 6
        start += 2 if self.data.startswith(b"\r\n", start) else 1
        length = self.of(head.get("Length"))
        end = start + length if isinstance(length, int) and self.data[start + length : start + length + 12].strip(b"\r\n ").startswith(b"endstr") else self.data.find(b"endstream", start)
        raw = self.data[start : end if end >= 0 else len(self.data)]
        filters = self.of(head.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f not in ("FlateDecode", "Fl"):
                return b""
            raw = zlib.decompressobj().decompress(raw, 64 << 20)
        return raw

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit."""
        out, seen = [], set()

        def walk(ref, inherited):
            node = self.of(ref)
            if not isinstance(node, dict) or int(ref) in seen or len(seen) > 200_000:
                return
            seen.add(int(ref))
            own = inherited | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            kids = self.of(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    if isinstance(kid, Ref):
                        walk(kid, own)
            else:
                out.append(node | own)

        root = self.of(self.trailer.get("Root"))
        if isinstance(root, dict) and isinstance(root.get("Pages"), Ref):
            walk(root["Pages"], {})
        return out

    def meta(self) -> dict[str, str]:
        info = self.of(self.trailer.get("Info"))
        text = lambda v: v.decode("utf-16", "replace") if v[:2] in (b"\xfe\xff", b"\xff\xfe") else v.decode("latin-1")
        return {META[k]: text(self.of(v)) for k, v in info.items() if k in META and isinstance(self.of(v), bytes)} if isinstance(info, dict) else {}


def _times(a, b):
    return a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]


def _box(m, x0, y0, x1, y1):
    xs, ys = zip(*((x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]) for x in (x0, x1) for y in (y0, y1)), strict=True)
    return min(xs), min(ys), max(xs), max(ys)


class Font:
    def __init__(self, pdf: Pdf, font: dict):
        self.wide = font.get("Subtype") == "Type0"
        first, widths = pdf.of(font.get("FirstChar")) or 0, pdf.of(font.get("Widths")) or []
        self.widths = {first + k: w for k, w in enumerate(map(pdf.of, widths)) if isinstance(w, (int, float))}
        self.map: dict[int, str] = {}
        if isinstance(font.get("ToUnicode"), Ref):
            body = pdf.stream(int(font["ToUnicode"]))
            text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
            for part in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
                self.map |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<((?:[0-9A-Fa-f]{4})+)>", part)}
            for part in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
                for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]{4})>", part):
                    low, high = int(a, 16), min(int(b, 16), int(a, 16) + 65_535)
                    self.map |= {k: chr(int(c, 16) + k - low) for k in range(low, high + 1)}

    def glyphs(self, raw: bytes):
        """(code, character, width) of each code."""
        codes = [int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw) - 1, 2)] if self.wide else list(raw)
        for c in codes:
            yield c, self.map.get(c, bytes([c]).decode("cp1252", "replace") if c < 256 else "�"), self.widths.get(c, 1000 if self.wide else 500) / 1000


class Painter:
    """Runs a page's operators and keeps glyphs and filled rectangles with their turn."""

    def __init__(self, pdf: Pdf):
        self.pdf, self.glyphs, self.rects, self.turn = pdf, [], [], 0

    def run(self, body: bytes, resources: dict, matrix=(1, 0, 0, 1, 0, 0), depth: int = 0) -> None:
        pdf = self.pdf
        resources = pdf.of(resources) or {}
        fonts, forms, states = (pdf.of(resources.get(k)) or {} for k in ("Font", "XObject", "ExtGState"))
        known: dict[str, Font] = {}
        state = {"m": matrix, "fill": [0.0], "alpha": 1.0, "font": None, "size": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "mode": 0, "rise": 0.0}
        kept, stack, lexer = [], [], Lexer(body)
        text = line = (1, 0, 0, 1, 0, 0)
        path: list[tuple] = []

        def show(raw: bytes) -> None:
            nonlocal text
            font = state["font"]
            for code, char, width in font.glyphs(raw) if font else ():
                move = (width * state["size"] + state["char"] + (state["word"] if code == 32 else 0)) * state["scale"]
                m = _times((state["size"] * state["scale"], 0, 0, state["size"], 0, state["rise"]), _times(text, state["m"]))
                self.turn += 1
                self.glyphs.append((self.turn, char, *_box(m, 0, -0.2, width, 0.8), state["fill"], state["mode"] in (3, 7)))
                text = _times((1, 0, 0, 1, move, 0), text)

        while (value := lexer.value()) is not None:
            if not isinstance(value, Word):
                stack.append(value)
                del stack[:-512]
                continue
            op, args = bytes(value), [v for v in stack if isinstance(v, (int, float)) and not isinstance(v, bool)]
            if op == b"q":
                kept.append(dict(state))
                del kept[:-256]
            elif op == b"Q" and kept:
                state = kept.pop()
            elif op == b"cm" and len(args) >= 6:
                state["m"] = _times(args[-6:], state["m"])
            elif op in (b"g", b"rg", b"k", b"sc", b"scn"):
                n = {b"g": 1, b"rg": 3, b"k": 4}.get(op, len(args))
                state["fill"] = [float(a) for a in args[-n:]] if n and len(args) >= n else None
            elif op == b"gs" and stack and isinstance(stack[-1], Name):
                alpha = pdf.of((pdf.of(states.get(str(stack[-1]))) or {}).get("ca"))
                state["alpha"] = float(alpha) if isinstance(alpha, (int, float)) else state["alpha"]
            elif op == b"BT":
                text = line = (1, 0, 0, 1, 0, 0)
            elif op == b"Tf" and len(stack) >= 2 and isinstance(stack[-2], Name) and args:
                name = str(stack[-2])
                if name not in known:
                    font = pdf.of(fonts.get(name))
                    known[name] = Font(pdf, font if isinstance(font, dict) else {})
                state["font"], state["size"] = known[name], args[-1]
            elif op in (b"Td", b"TD") and len(args) >= 2:
                state["lead"] = -args[-1] if op == b"TD" else state["lead"]
                text = line = _times((1, 0, 0, 1, *args[-2:]), line)
            elif op == b"Tm" and len(args) >= 6:
                text = line = tuple(args[-6:])
            elif op in (b"Tc", b"Tw", b"TL", b"Ts", b"Tr", b"Tz") and args:
                key = {b"Tc": "char", b"Tw": "word", b"TL": "lead", b"Ts": "rise", b"Tr": "mode", b"Tz": "scale"}[op]
                state[key] = args[-1] / 100 if op == b"Tz" else args[-1]
            elif op in (b"T*", b"'", b'"'):
                text = line = _times((1, 0, 0, 1, 0, -state["lead"]), line)
            if op in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
                show(stack[-1])
            elif op == b"TJ" and stack and isinstance(stack[-1], list):
                for part in stack[-1]:
                    if isinstance(part, bytes):
                        show(part)
                    elif isinstance(part, (int, float)):
                        text = _times((1, 0, 0, 1, -part / 1000 * state["size"] * state["scale"], 0), text)
            elif op == b"re" and len(args) >= 4:
                x, y, w, h = args[-4:]
                path.append(_box(state["m"], x, y, x + w, y + h))
            elif op in (b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*", b"S", b"s", b"n"):
                for box in path:
                    self.turn += 1
                    self.rects.append((self.turn, *box, state["fill"], op not in (b"S", b"s", b"n"), state["alpha"]))
                path = []
            elif op == b"Do" and stack and isinstance(stack[-1], Name) and depth < 8:
                ref = forms.get(str(stack[-1]))
                form = pdf.of(ref)
                if isinstance(form, dict) and form.get("Subtype") == "Form" and isinstance(ref, Ref):
                    own = [v for v in (pdf.of(form.get("Matrix")) or ()) if isinstance(v, (int, float))]
                    self.run(pdf.stream(int(ref)), form.get("Resources") or resources, _times(own, state["m"]) if len(own) == 6 else state["m"], depth + 1)
            elif op == b"ID":
                end = body.find(b"EI", lexer.at)
                lexer.at = end + 2 if end >= 0 else len(body)
            stack = []


def read(data: bytes):
    """(metadata, pages) of a file; a page is a dictionary with its frame, glyphs and rectangles, or an error."""
    pdf = Pdf(data)
    numbers = lambda v: [float(x) for x in map(pdf.of, pdf.of(v) or ()) if isinstance(x, (int, float))]
    pages = []
    for node in pdf.pages():
        media = numbers(node.get("MediaBox"))
        page = {"media": media if len(media) == 4 else LETTER, "rotation": 0, "glyphs": [], "rects": [], "error": None}
        try:
            crop = numbers(node.get("CropBox"))
            page["crop"] = crop if len(crop) == 4 else page["media"]
            page["rotation"] = int(pdf.of(node.get("Rotate")) or 0) % 360
            contents = pdf.of(node.get("Contents")) if isinstance(pdf.of(node.get("Contents")), list) else [node.get("Contents")]
            painter = Painter(pdf)
            painter.run(b"\n".join(pdf.stream(int(c)) for c in contents if isinstance(c, Ref)), node.get("Resources") or {})
            page |= {"glyphs": painter.glyphs, "rects": painter.rects}
        except (ValueError, TypeError, KeyError, IndexError, RecursionError, zlib.error, OverflowError) as error:
            page["error"] = f"{type(error).__name__}: {error}"[:200]
        page.setdefault("crop", page["media"])
        pages.append(page)
    return pdf.meta(), pages


_SHAPE = "x0: double, y0: double, x1: double, y1: double, colour: array<double>"
SCHEMA = (
    "path string, page int, n_pages int, meta map<string, string>, width double, height double, rotation int, error string, "
    f"glyphs array<struct<seq: int, text: string, {_SHAPE}, invisible: boolean>>, rects array<struct<seq: int, {_SHAPE}, filled: boolean, opacity: double>>"
)


def pages(files: DataFrame) -> DataFrame:
    """One row a page of ``files(path, content)``, and one with an error for a file that can't be read; places are points from the top left of what is shown."""

    def turned(box, page):
        """Edges from the upper left corner of the page as it is shown."""
        m, c = page["media"], page["crop"]
        left, low, right, high = max(min(m[0], m[2]), min(c[0], c[2])), max(min(m[1], m[3]), min(c[1], c[3])), min(max(m[0], m[2]), max(c[0], c[2])), min(max(m[1], m[3]), max(c[1], c[3]))
        if right <= left or high <= low:
            left, low, right, high = min(m[0], m[2]), min(m[1], m[3]), max(m[0], m[2]), max(m[1], m[3])
        w, h = right - left, high - low
        x0, y0, x1, y1 = box[0] - left, high - box[3], box[2] - left, high - box[1]
        turn = page["rotation"]
        if turn == 90:
            x0, y0, x1, y1 = h - y1, x0, h - y0, x1
        elif turn == 180:
            x0, y0, x1, y1 = w - x1, h - y1, w - x0, h - y0
        elif turn == 270:
            x0, y0, x1, y1 = y0, w - x1, y1, w - x0
        return (x0, y0, x1, y1), ((h, w) if turn in (90, 270) else (w, h))

    def run(frames):
        import pandas as pd

        names = ["path", "page", "n_pages", "meta", "width", "height", "rotation", "error", "glyphs", "rects"]
        for frame in frames:
            out = []
            for path, content in zip(frame.path, frame.content, strict=True):
                try:
                    meta, found = read(bytes(content))
                except (ValueError, TypeError, KeyError, IndexError, RecursionError, zlib.error, OverflowError) as error:
                    out.append((path, None, 0, {}, None, None, None, f"{type(error).__name__}: {error}"[:200], [], []))
                    continue
                for k, page in enumerate(found, 1):
                    size = turned((0, 0, 0, 0), page)[1]
                    shape = lambda b, colour, page=page: dict(zip(("x0", "y0", "x1", "y1"), turned(b, page)[0], strict=True)) | {"colour": colour}
                    glyphs = [{"seq": g[0], "text": g[1], **shape(g[2:6], g[6]), "invisible": g[7]} for g in page["glyphs"]]
                    rects = [{"seq": r[0], **shape(r[1:5], r[5]), "filled": r[6], "opacity": r[7]} for r in page["rects"]]
                    out.append((path, k, len(found), meta, *size, page["rotation"], page["error"], glyphs, rects))
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def glyphs(read_pages: DataFrame) -> DataFrame:
    """Glyphs as ``operators.redaction`` takes them: places in fractions of the page, colours reduced."""
    from dossier.functions import colours

    g = read_pages.where("page is not null").select(F.col("path").alias("doc_id"), "page", "width", "height", F.posexplode("glyphs").alias("gid", "g"))
    part = lambda a, of: F.col(f"g.{a}") / F.col(of)
    return g.select("doc_id", "page", "gid", "g.seq", "g.text", part("x0", "width").alias("x"), part("y0", "height").alias("y"), (part("x1", "width") - part("x0", "width")).alias("w"), (part("y1", "height") - part("y0", "height")).alias("h"), colours.rgb(F.col("g.colour")).alias("colour"), "g.invisible")


def rectangles(read_pages: DataFrame) -> DataFrame:
    from dossier.functions import colours

    r = read_pages.where("page is not null").select(F.col("path").alias("doc_id"), "page", "width", "height", F.posexplode("rects").alias("rid", "r"))
    part = lambda a, of: F.col(f"r.{a}") / F.col(of)
    return r.select("doc_id", "page", "rid", "r.seq", part("x0", "width").alias("x"), part("y0", "height").alias("y"), (part("x1", "width") - part("x0", "width")).alias("w"), (part("y1", "height") - part("y0", "height")).alias("h"), F.col("width").alias("page_w"), F.col("height").alias("page_h"), "r.filled", "r.opacity", colours.rgb(F.col("r.colour")).alias("colour"))


def words(glyph_rows: DataFrame) -> DataFrame:
    """(doc_id, page, pos, text, line, x, y, w, h, conf) of glyphs: lines by the distance of centres, words by gaps, in reading order."""
    from pyspark.sql import Window

    page = ["doc_id", "page"]
    centre = F.col("y") + F.col("h") / 2
    slack = F.greatest(F.percentile_approx("h", 0.5).over(Window.partitionBy(*page)) * 0.4, F.lit(1e-6))
    down = Window.partitionBy(*page).orderBy("centre", "x")
    rows = glyph_rows.withColumns({"centre": centre, "slack": slack}).withColumn("new", F.coalesce((F.col("centre") - F.lag("centre").over(down) > F.col("slack")).cast("int"), F.lit(0)))
    rows = rows.withColumn("line", F.sum("new").over(down).cast("int"))
    along = Window.partitionBy(*page, "line").orderBy("x", "seq")
    blank = F.trim("text") == ""
    gap = F.col("x") - (F.lag("x").over(along) + F.lag("w").over(along)) > F.col("h") * 0.15
    starts = F.coalesce(gap | F.lag(blank).over(along), F.lit(True))
    rows = rows.withColumn("word", F.sum(starts.cast("int")).over(along)).where(~blank)
    found = rows.groupBy(*page, "line", "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "text"))), lambda g: g["text"]), "").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
    pos = F.row_number().over(Window.partitionBy(*page).orderBy("line", "word")) - 1
    return found.withColumn("pos", pos).select(*page, "pos", "text", "line", "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"), F.lit(-1).alias("conf"))
