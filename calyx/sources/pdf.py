"""PDF text and ruled tables with the standard library alone.

Files are parsed inside ``mapInPandas``: objects, object streams and Flate streams
are read, the page tree is walked in order, and each page's content stream is run
by a small machine that places every shown string. Codes become text by the font's
ToUnicode map, else as Windows Latin. Lines are strings of about the same height,
from left to right; tables are grids of ruling lines or boxes that meet.
Encrypted files, other filters, and fonts with two-byte codes and no map give no text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from calyx.sources import documents

PAGE_SCHEMA = "doc string, page int, text string, error string"
CELL_SCHEMA = "doc string, page int, table_idx int, row int, col int, text string, error string"
_TOKEN = re.compile(rb"<<|>>|\[|\]|/[^\s/<>\[\]()%{}]*|<[0-9A-Fa-f\s]*>|[-+]?(?:\d+\.?\d*|\.\d+)|\(|%[^\r\n]*|[A-Za-z'\"*][A-Za-z0-9'\"*]*")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A PDF name."""


class Op(bytes):
    """An operator or keyword; strings are plain bytes."""


class Ref(int):
    """The number of an object."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in brackets that opens at ``at``, and where it ends."""
    out, depth = bytearray(), 0
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            nxt = data[at : at + 1]
            if octal := re.match(rb"[0-7]{1,3}", data[at : at + 3]):
                out.append(int(octal[0], 8) & 255)
                at += len(octal[0])
            else:
                out += _ESCAPES.get(nxt, b"" if nxt in (b"\n", b"\r") else nxt)
                at += 1
            continue
        depth += (c == b"(") - (c == b")")
        if depth == 0:
            break
        if not (c == b"(" and depth == 1):
            out += c
    return bytes(out), at


def _values(data: bytes):
    """Values and operators of a piece of PDF syntax, one by one."""
    at = 0
    stack: list[list] = []
    while m := _TOKEN.search(data, at):
        token, at = m[0], m.end()
        if token == b"(":
            value, at = _string(data, m.start())
        elif token in (b"<<", b"["):
            stack.append([token])
            continue
        elif token in (b">>", b"]"):
            if not stack:
                continue
            items = stack.pop()[1:]
            value = items if token == b"]" else {k: v for k, v in zip(items[::2], items[1::2])}
        elif token[:1] == b"<":
            digits = re.sub(rb"\s", b"", token[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif token[:1] == b"/":
            value = Name(token[1:].decode("latin-1"))
        elif token[:1] == b"%":
            continue
        elif token[:1] in b"+-.0123456789":
            value = float(token) if b"." in token else int(token)
        else:
            value = Op(token)
            items = stack[-1] if stack else None
            if token == b"R" and items is not None and len(items) >= 3:
                items.pop()
                items[-1] = Ref(items[-1])
                continue
        if stack:
            stack[-1].append(value)
            continue
        yield value, at


class File:
    """The objects of a file, found by scanning it, and its pages in order."""

    def __init__(self, data: bytes):
        if b"%PDF" not in data[:1024]:
            raise ValueError("no PDF file")
        if re.search(rb"/Encrypt\s", data):
            raise ValueError("the file is encrypted")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", data):
            self._object(int(m[1]), data, m.end())
        for number, value in list(self.objects.items()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                self._packed(value, self.stream(number))
        root = next((v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        if root is None:
            raise ValueError("no catalogue of pages")
        self.pages = list(self._leaves(root.get("Pages"), {}, set()))

    def _object(self, number: int, data: bytes, at: int) -> None:
        end = data.find(b"endobj", at)
        begin = re.compile(rb"\bstream\r?\n").search(data, at, end if end >= 0 else len(data))
        head = data[at : begin.start() if begin else end if end >= 0 else len(data)]
        value = next((v for v, _ in _values(head)), None)
        self.objects[number] = value
        if begin and isinstance(value, dict):
            length = value.get("Length")
            stop = begin.end() + length if isinstance(length, int) and not isinstance(length, Ref) else -1
            if stop < 0 or not data[stop : stop + 16].lstrip().startswith(b"endstream"):  # a length that is elsewhere, or wrong
                stop = data.find(b"endstream", begin.end())
            self.streams[number] = data[begin.end() : stop if stop >= 0 else len(data)]

    def _packed(self, head: dict, body: bytes) -> None:
        first, count = self.get(head.get("First")), self.get(head.get("N"))
        numbers = [int(x) for x in body[:first].split()[: 2 * count]]
        for number, offset in zip(numbers[::2], numbers[1::2]):
            self.objects.setdefault(number, next((v for v, _ in _values(body[first + offset :])), None))

    def get(self, value):
        seen = 0
        while isinstance(value, Ref) and seen < 32:
            value, seen = self.objects.get(int(value)), seen + 1
        return value

    def stream(self, number: int) -> bytes:
        head, data = self.objects.get(number), self.streams.get(number, b"")
        kinds = self.get(head.get("Filter")) if isinstance(head, dict) else None
        for kind in kinds if isinstance(kinds, list) else [kinds] if kinds else []:
            if kind != "FlateDecode":
                raise ValueError(f"filter {kind} is not read")
            data = zlib.decompressobj().decompress(data)
        return data

    def _leaves(self, ref, inherited: dict, seen: set):
        node = self.get(ref)
        if not isinstance(node, dict) or (isinstance(ref, Ref) and int(ref) in seen):
            return
        own = inherited | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
        if "Kids" in node:
            for kid in self.get(node["Kids"]) or []:
                yield from self._leaves(kid, own, seen | ({int(ref)} if isinstance(ref, Ref) else set()))
        else:
            yield own | node

    def content(self, page: dict) -> bytes:
        parts = page.get("Contents")
        parts = parts if isinstance(parts, list) else self.get(parts) if isinstance(self.get(parts), list) else [parts]
        return b"\n".join(self.stream(int(p)) for p in parts if isinstance(p, Ref))

    def fonts(self, page: dict) -> dict[str, Codes | None]:
        """By name the codes of each font; None: one byte, Windows Latin."""
        resources = self.get(page.get("Resources")) or {}
        out: dict[str, Codes | None] = {}
        for name, ref in (self.get(resources.get("Font")) or {}).items():
            font = self.get(ref) or {}
            two = font.get("Subtype") == "Type0"
            mapped = font.get("ToUnicode")
            data = self.stream(int(mapped)) if isinstance(mapped, Ref) else b""
            out[name] = Codes(data, 2 if two else 1) if two or isinstance(mapped, Ref) else None
        return out


class Codes:
    """What the codes of a font mean; ranges stay ranges."""

    def __init__(self, data: bytes, width: int):
        self.width = width
        self.single: dict[int, str] = {}
        self.ranges: list[tuple[int, int, bytes]] = []
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
            items = [v for v, _ in _values(block)]
            self.single |= {int.from_bytes(a): self._text(b) for a, b in zip(items[::2], items[1::2])}
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
            items = [v for v, _ in _values(block)]
            for low, high, to in zip(items[::3], items[1::3], items[2::3]):
                low, high = int.from_bytes(low), int.from_bytes(high)
                if isinstance(to, list):
                    self.single |= {low + i: self._text(t) for i, t in enumerate(to[: high - low + 1])}
                else:
                    self.ranges.append((low, high, to))

    @staticmethod
    def _text(data: bytes) -> str:
        return data.decode("utf-16-be", "surrogatepass")

    def __getitem__(self, code: int) -> str:
        if code not in self.single:
            found = next(((low, to) for low, high, to in self.ranges if low <= code <= high), None)
            self.single[code] = self._text(found[1][:-2] + ((int.from_bytes(found[1][-2:]) + code - found[0]) & 0xFFFF).to_bytes(2)) if found else ""
        return self.single[code]

    def decoded(self, data: bytes) -> str:
        said = "".join(self[int.from_bytes(data[i : i + self.width])] for i in range(0, len(data), self.width))
        return said.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@dataclass
class Shown:
    """Strings with their place from the top left, and ruling lines, of one page."""

    strings: list[tuple[float, float, float, float, str]] = field(default_factory=list)  # x0, top, x1, bottom, text
    lines: list[tuple[float, float, float, float]] = field(default_factory=list)


def _times(m, n):
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o)


def shown(file: File, page: dict) -> Shown:
    """Run the content stream of a page."""
    box = [float(file.get(v)) for v in file.get(page.get("MediaBox")) or (0, 0, 612, 792)]
    height, out, fonts = box[3], Shown(), file.fonts(page)
    unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, saved, text, line, font, size, leading, args = unit, [], unit, unit, None, 1.0, 0.0, []
    point = start = None

    def place(x: float, y: float, m) -> tuple[float, float]:
        return x * m[0] + y * m[2] + m[4] - box[0], height - (x * m[1] + y * m[3] + m[5])

    def show(parts: list) -> None:
        nonlocal text
        codes, said, width = fonts.get(font), "", 0.0
        for part in parts:
            if isinstance(part, bytes) and not isinstance(part, Op):
                piece = part.decode("cp1252", "replace") if codes is None else codes.decoded(part)
                said += piece
                width += sum(1.0 if ord(c) > 0x2E7F else 0.5 for c in piece) * size
            elif isinstance(part, (int, float)):
                if part < -200 and said and not said.endswith(" "):
                    said += " "
                width -= part / 1000 * size
        m = _times(text, ctm)
        (x0, bottom), (x1, _) = place(0, 0, m), place(width, 0, m)
        tall = abs(size * m[3]) or abs(size * m[1]) or size
        if said.strip():
            out.strings.append((min(x0, x1), bottom - tall, max(x0, x1), bottom, said))
        text = _times((1, 0, 0, 1, width, 0), text)

    def rule(a: tuple[float, float], b: tuple[float, float]) -> None:
        (x0, y0), (x1, y1) = place(*a, ctm), place(*b, ctm)
        out.lines.append((min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)))

    def next_line(x: float, y: float) -> None:
        nonlocal text, line
        line = text = _times((1, 0, 0, 1, x, y), line)

    for value, _ in _values(file.content(page)):
        if not isinstance(value, Op) or value in (b"true", b"false", b"null"):
            args.append(value)
            continue
        op, a = value, args
        args = []
        try:
            if op == b"q":
                saved.append(ctm)
            elif op == b"Q":
                ctm = saved.pop() if saved else unit
            elif op == b"cm":
                ctm = _times(a[-6:], ctm)
            elif op == b"BT":
                text = line = unit
            elif op == b"Tf":
                font, size = str(a[-2]), float(a[-1])
            elif op == b"TL":
                leading = a[-1]
            elif op == b"Td":
                next_line(a[-2], a[-1])
            elif op == b"TD":
                leading = -a[-1]
                next_line(a[-2], a[-1])
            elif op == b"Tm":
                text = line = tuple(float(x) for x in a[-6:])
            elif op == b"T*":
                next_line(0, -leading)
            elif op == b"Tj":
                show([a[-1]])
            elif op == b"TJ":
                show(a[-1])
            elif op in (b"'", b'"'):
                next_line(0, -leading)
                show([a[-1]])
            elif op == b"re":
                x, y, w, h = a[-4:]
                for p, r in (((x, y), (x + w, y)), ((x, y + h), (x + w, y + h)), ((x, y), (x, y + h)), ((x + w, y), (x + w, y + h))):
                    rule(p, r)
            elif op == b"m":
                point = start = (a[-2], a[-1])
            elif op == b"l" and point is not None:
                rule(point, (a[-2], a[-1]))
                point = (a[-2], a[-1])
            elif op == b"h" and point is not None and start is not None:
                rule(point, start)
        except (IndexError, TypeError, ValueError):  # an operator without its operands is passed over
            continue
    return out


def _outside(strings: list, boxes: Sequence[Sequence[float]]) -> list:
    meets = lambda s, b: s[0] <= b[2] and s[2] >= b[0] and s[1] <= b[3] and s[3] >= b[1]
    return [s for s in strings if not any(meets(s, b) for b in boxes)]


def page_text(strings: list) -> str:
    """Lines from top to bottom; strings of a line from left to right, a space where a gap lies between."""
    lines: list[list] = []
    for s in sorted(strings, key=lambda s: (s[3], s[0])):
        if lines and abs(lines[-1][0][3] - s[3]) <= 0.4 * max(1.0, s[3] - s[1]):
            lines[-1].append(s)
        else:
            lines.append([s])
    out = []
    for line in lines:
        line.sort(key=lambda s: s[0])
        joined = line[0][4]
        for before, s in zip(line, line[1:]):
            gap = s[0] - before[2] > 0.15 * (s[3] - s[1])
            joined += (" " if gap and not joined.endswith(" ") and not s[4].startswith(" ") else "") + s[4]
        out.append(joined.rstrip())
    return "\n".join(out)


def page_tables(found: Shown, near: float = 2.0) -> list[list[list[str]]]:
    """Grids of lines that meet, from top to bottom, as rows of cell texts."""
    flat = [e for e in found.lines if e[3] - e[1] <= near and e[2] - e[0] > near]
    tall = [e for e in found.lines if e[2] - e[0] <= near and e[3] - e[1] > near]
    groups: list[tuple[list, list]] = []
    for h in flat:
        meets = lambda v: v[0] >= h[0] - near and v[0] <= h[2] + near and v[1] <= h[1] + near and v[3] >= h[1] - near  # noqa: E731, B023
        own = [v for v in tall if meets(v)]
        joined = [g for g in groups if any(v in g[1] for v in own)]
        merged = ([h], list(dict.fromkeys(own)))
        for g in joined:
            merged = (g[0] + merged[0], list(dict.fromkeys(g[1] + merged[1])))
            groups.remove(g)
        groups.append(merged)
    tables = []
    for hs, vs in groups:
        ys, xs = _places([h[1] for h in hs], near), _places([v[0] for v in vs], near)
        if len(ys) < 2 or len(xs) < 2:
            continue
        cells = [[[] for _ in xs[1:]] for _ in ys[1:]]
        for s in found.strings:
            x, y = s[0] + min(1.0, (s[2] - s[0]) / 2), (s[1] + s[3]) / 2
            row = next((i for i in range(len(ys) - 1) if ys[i] <= y <= ys[i + 1]), None)
            col = next((i for i in range(len(xs) - 1) if xs[i] <= x <= xs[i + 1]), None)
            if row is not None and col is not None:
                cells[row][col].append(s)
        tables.append((ys[0], [[page_text(c) for c in row] for row in cells]))
    return [t for _, t in sorted(tables, key=lambda t: t[0])]


def _places(values: list[float], near: float) -> list[float]:
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > near:
            out.append(v)
    return out


def _each(content: bytes, pages: Sequence[int] | None, boxes: dict[int, list]):
    file = File(content)
    for number, page in enumerate(file.pages, 1):
        if pages is None or number in pages:
            found = shown(file, page)
            found.strings = _outside(found.strings, boxes.get(number, []))
            yield number, found


def pdf_pages(files: DataFrame, pages: Sequence[int] | None = None, boxes: dict[int, list] | None = None) -> DataFrame:
    """``doc, page, text, error`` of files ``path, content``: the pages asked for, from 1, that exist.

    ``boxes``: of a page, boxes (x0, top, x1, bottom) whose text is left out. A file
    that cannot be read gives one row with its error.
    """
    return documents.parsed(files, lambda c: [{"page": n, "text": page_text(f.strings)} for n, f in _each(c, pages, boxes or {})], PAGE_SCHEMA)


def pdf_cells(files: DataFrame, pages: Sequence[int] | None = None, near_keyword: str | None = None, boxes: dict[int, list] | None = None) -> DataFrame:
    """Cells of ruled tables with their page; ``near_keyword``: only of pages whose text holds it."""

    def parse(content: bytes) -> list[dict]:
        rows = []
        for number, found in _each(content, pages, boxes or {}):
            if near_keyword is not None and near_keyword not in page_text(found.strings):
                continue
            for t, table in enumerate(page_tables(found)):
                rows += [{"page": number, "table_idx": t, "row": r, "col": c, "text": x} for r, row in enumerate(table) for c, x in enumerate(row)]
        return rows

    return documents.parsed(files, parse, CELL_SCHEMA)


def read_pdf(spark: SparkSession, path: str, pages: Sequence[int] | None = None, boxes: dict[int, list] | None = None) -> DataFrame:
    return pdf_pages(documents.binary_files(spark, path, "*.[pP][dD][fF]"), pages, boxes)


def read_pdf_tables(spark: SparkSession, path: str, pages: Sequence[int] | None = None, near_keyword: str | None = None) -> DataFrame:
    return pdf_cells(documents.binary_files(spark, path, "*.[pP][dD][fF]"), pages, near_keyword)


def simple_pdf(pages: Sequence[Sequence[str]], tables: Sequence[Sequence[Sequence[str]] | None] = (), compress: bool = True) -> bytes:
    """A file with the lines of each page and, below them, its table with ruled cells."""
    hexed = lambda s: f"<{s.encode('utf-16-be', 'surrogatepass').hex()}>"
    bodies = []
    for n, lines in enumerate(pages):
        ops, y = [], 800
        for line in lines:
            ops.append(f"BT /F1 10 Tf 1 0 0 1 50 {y} Tm {hexed(line)} Tj ET")
            y -= 14
        for r, row in enumerate(tables[n] if n < len(tables) and tables[n] else ()):
            for c, cell in enumerate(row):
                ops.append(f"{50 + 120 * c} {y - 20 * (r + 1)} 120 20 re S BT /F1 10 Tf 1 0 0 1 {54 + 120 * c} {y - 20 * (r + 1) + 6} Tm {hexed(cell)} Tj ET")
        bodies.append("\n".join(ops).encode())
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    pack = lambda b: (b"/Filter /FlateDecode ", zlib.compress(b)) if compress else (b"", b)
    stream = lambda b: b"<< %s/Length %d >>\nstream\n%s\nendstream" % ((p := pack(b))[0], len(p[1]), p[1])
    kids = " ".join(f"{5 + 2 * i} 0 R" for i in range(len(bodies)))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(bodies)} /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> >>".encode(),
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Any /Encoding /Identity-H /ToUnicode 4 0 R >>", stream(cmap),
    ]
    for i, body in enumerate(bodies):
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {6 + 2 * i} 0 R >>".encode(), stream(body)]
    out, offsets = bytearray(b"%PDF-1.7\n"), []
    for n, data in enumerate(objects, 1):
        offsets.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, data)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, start))
