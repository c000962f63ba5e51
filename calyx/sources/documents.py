"""Readers of office documents and text files as DataFrames.

Every reader lists files with ``binaryFile`` (so listing, globbing and splitting
over executors are Spark's) and parses each file with the standard library inside
``mapInPandas``. A file that cannot be read gives one row with its ``error`` and
does not fail the job. Files larger than ``spark.sql.sources.binaryFile.maxLength``
are refused by Spark.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_ZIP = b"PK\x03\x04"
#: Encodings tried in order for plain text.
ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "utf-16")


def listed(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """``path, name, size, modified`` of files with one of the extensions, without lock files, in order of lower-case name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    kept = files.where(~F.col("name").startswith("~$"))
    if extensions:
        kept = kept.where(F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*[e.lower().lstrip(".") for e in extensions]))
    return kept.orderBy(F.lower("name"), "path")


def binary_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, content`` of the files below a path whose names fit the pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def parsed(files: DataFrame, parse: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """The rows that ``parse`` makes of each of the files ``path, content``, after the file's name as ``doc``."""
    columns = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [{"doc": name, "error": None, **r} for r in parse(bytes(content))]
                except Exception as e:  # one bad file is a row, not a failed job
                    rows = [{"doc": name, "error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda d: d.notna(), None)

    return files.select("path", "content").mapInPandas(run, schema)



def _paragraph(p: ET.Element) -> str:
    return "".join(t.text or "" for t in p.iter(f"{_W}t"))


def _docx(content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    rows, para, table, title = [], 0, 0, ""
    for el in body:
        if el.tag == f"{_W}p":
            text = _paragraph(el)
            rows.append({"kind": "paragraph", "idx": para, "text": text})
            para += 1
            if text.strip().startswith("表"):
                title = text.strip()
        elif el.tag == f"{_W}tbl":
            for r, tr in enumerate(el.findall(f"{_W}tr")):
                for c, tc in enumerate(tr.findall(f"{_W}tc")):
                    text = "\n".join(_paragraph(p) for p in tc.findall(f"{_W}p"))
                    rows.append({"kind": "cell", "idx": table, "row": r, "col": c, "text": text, "title": title})
            table += 1
    return rows


DOCX_ROWS = "doc string, kind string, idx int, row int, col int, text string, title string, error string"


def docx_rows(files: DataFrame) -> DataFrame:
    """Paragraphs (empty ones kept, so the index is the position) and cells of top-level tables with the title above."""
    return parsed(files, _docx, DOCX_ROWS)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return docx_rows(binary_files(spark, path, "*.docx"))


def _docx_fast(content: bytes) -> list[dict]:
    """All paragraphs with text, those of tables too; of a part that is no good XML, what its text tags hold."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        data = z.read("word/document.xml")
    try:
        lines, way = [_paragraph(p) for p in ET.fromstring(data).iter(f"{_W}p")], "fast"
    except ET.ParseError:
        raw = data.decode("utf-8", "replace")
        pieces = re.split(r"</w:p\s*>", raw)
        lines, way = [html.unescape("".join(re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)", p))) for p in pieces], "fallback"
    return [{"text": "\n".join(x for x in lines if x), "way": way}]


def docx_fast(files: DataFrame) -> DataFrame:
    """``doc, text, way, error``: fast text of each document, by a tolerant reader where its XML does not parse."""
    return parsed(files, _docx_fast, "doc string, text string, way string, error string")


def read_docx_text(spark: SparkSession, path: str) -> DataFrame:
    return docx_fast(binary_files(spark, path, "*.docx"))


def docx_text(spark: SparkSession, path: str) -> DataFrame:
    """``doc, text`` with the paragraphs of each document in one text."""
    rows = read_docx(spark, path).where("kind = 'paragraph'")
    return rows.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), "\n").alias("text"))


def _xlsx(content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        rows = []
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = links[sheet.get(f"{_R}id")].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            for cell in ET.fromstring(z.read(part)).iter(f"{_S}c"):
                letters, number = re.match(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                col = 0
                for letter in letters:
                    col = col * 26 + ord(letter) - 64
                value = cell.find(f"{_S}v")
                text = value.text if value is not None else "".join(t.text or "" for t in cell.iter(f"{_S}t")) or None
                if cell.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                rows.append({"sheet": sheet.get("name"), "row": int(number), "col": col, "value": text})
    return rows


def xlsx_cells(files: DataFrame) -> DataFrame:
    """Cells of all sheets, rows and columns counted from 1, values as text."""
    return parsed(files, _xlsx, "doc string, sheet string, row int, col int, value string, error string")


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    return xlsx_cells(binary_files(spark, path, "*.xlsx"))


def xlsx_text(cells: DataFrame) -> DataFrame:
    """One text per sheet; rows and columns without any value are left out."""
    filled = cells.where("value is not null and trim(value) <> ''")
    lines = filled.groupBy("doc", "sheet", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "value"))), lambda s: s["value"]), "\t").alias("line"))
    return lines.groupBy("doc", "sheet").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda s: s["line"]), "\n").alias("text"))


def _pptx(content: bytes) -> list[dict]:
    rows = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for at, name in enumerate(slides):
            root = ET.fromstring(z.read(name))
            tree = root.find(f".//{_P}spTree")
            shapes = [s for s in tree if s.tag in (f"{_P}sp", f"{_P}pic", f"{_P}graphicFrame", f"{_P}grpSp")] if tree is not None else []
            texts, title = [], None
            for shape in shapes:
                lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in shape.iter(f"{_A}p")]
                text = "\n".join(x for x in lines if x)
                kind = shape.find(f".//{_P}ph")
                if title is None and kind is not None and kind.get("type") in ("title", "ctrTitle"):
                    title = text
                if text:
                    texts.append(text)
            notes, links, charts = None, [], {}
            rels = name.replace("slides/", "slides/_rels/") + ".rels"
            if rels in names:
                for r in ET.fromstring(z.read(rels)):
                    if r.get("Type", "").endswith("/hyperlink"):
                        links.append(r.get("Target"))
                    if r.get("Type", "").endswith("/chart"):
                        charts[r.get("Id")] = "ppt/" + r.get("Target").replace("../", "")
                    if r.get("Type", "").endswith("/notesSlide"):
                        part = "ppt/" + r.get("Target").replace("../", "")
                        if part in names:
                            notes = "\n".join(t.text or "" for t in ET.fromstring(z.read(part)).iter(f"{_A}t"))
            for ref in (c.get(f"{_R}id") for c in root.iter(f"{_C}chart")):
                if charts.get(ref) in names:
                    title_of = ET.fromstring(z.read(charts[ref])).find(f"{_C}chart/{_C}title")
                    named = "".join(t.text or "" for t in title_of.iter(f"{_A}t")) if title_of is not None else ""
                    texts += [named] if named else []
            cells = []
            for n, grid in enumerate(root.iter(f"{_A}tbl")):
                for y, tr in enumerate(grid.findall(f"{_A}tr")):
                    for x, tc in enumerate(tr.findall(f"{_A}tc")):
                        lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in tc.iter(f"{_A}p")]
                        cells.append({"table_idx": n, "row": y, "col": x, "text": "\n".join(lines)})
            has_table = root.find(f".//{_A}tbl") is not None
            rows.append({"slide_idx": at, "title": title, "text": "\n".join(texts), "notes": notes, "shape_count": len(shapes), "has_table": has_table, "links": links, "cells": cells})
    return rows


PPTX_SLIDES = "doc string, slide_idx int, title string, text string, notes string, shape_count int, has_table boolean, links array<string>, error string"


def pptx_slides(files: DataFrame) -> DataFrame:
    """Slides in order, with their texts and chart titles, notes, shape count and links."""
    return parsed(files, _pptx, PPTX_SLIDES)


def read_pptx(spark: SparkSession, path: str) -> DataFrame:
    return pptx_slides(binary_files(spark, path, "*.pptx"))


def _pptx_cells(content: bytes) -> list[dict]:
    return [{"slide_idx": slide["slide_idx"], **cell} for slide in _pptx(content) for cell in slide["cells"]]


PPTX_CELLS = "doc string, slide_idx int, table_idx int, row int, col int, text string, error string"


def pptx_cells(files: DataFrame) -> DataFrame:
    """Cells of the tables on slides."""
    return parsed(files, _pptx_cells, PPTX_CELLS)


def read_pptx_cells(spark: SparkSession, path: str) -> DataFrame:
    return pptx_cells(binary_files(spark, path, "*.pptx"))


def pptx_links(slides: DataFrame) -> DataFrame:
    return slides.select("doc", F.explode("links").alias("link")).distinct()


_PZFX_TITLE = re.compile(r"^\s*(\S*?岁\S*?)\s*(GMC|GMI|阳转率)\s*$")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _pzfx(content: bytes) -> list[dict]:
    if content[:4] == _ZIP:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            texts = [z.read(n) for n in z.namelist() if n.endswith(".xml")]
    else:
        texts = [content]
    rows = []
    for text in texts:
        for table in (e for e in ET.fromstring(text).iter() if _local(e.tag) == "Table"):
            title = next(("".join(e.itertext()).strip() for e in table if _local(e.tag) == "Title"), "")
            named = _PZFX_TITLE.match(title)
            if not named:
                continue
            for y, column in enumerate(e for e in table if _local(e.tag) == "YColumn"):
                for s, sub in enumerate(e for e in column if _local(e.tag) == "Subcolumn"):
                    for r, d in enumerate(e for e in sub if _local(e.tag) == "d"):
                        value = "".join(d.itertext()).strip()
                        rows.append({"table_id": table.get("ID"), "title": title, "age_band": named[1], "metric": named[2], "y": y, "sub": s, "row": r, "value": value})
    return rows


PZFX_VALUES = "doc string, table_id string, title string, age_band string, metric string, y int, sub int, row int, value string, error string"


def pzfx_rows(files: DataFrame) -> DataFrame:
    """Values of graph tables, plain or zipped, whose title names an age band and a metric."""
    return parsed(files, _pzfx, PZFX_VALUES)


def read_pzfx(spark: SparkSession, path: str) -> DataFrame:
    return pzfx_rows(binary_files(spark, path, "*.pzfx"))


def is_zip(content):
    """Whether binary content begins as a zip file does."""
    return F.hex(F.substring(content, 1, 4)) == "504B0304"


def _txt(content: bytes) -> list[dict]:
    for encoding in ENCODINGS:
        try:
            return [{"text": content.decode(encoding), "encoding": encoding}]
        except UnicodeError:
            continue
    raise ValueError("no encoding fits")


def text_files(files: DataFrame) -> DataFrame:
    """Whole files, decoded by the first encoding that fits."""
    return parsed(files, _txt, "doc string, text string, encoding string, error string")


def read_text(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    return text_files(binary_files(spark, path, pattern))


def csv_cells(files: DataFrame, skip_rows: int = 0) -> DataFrame:
    """Cells of CSV files in long form, after leading rows and the byte-order mark are dropped."""
    import csv

    def parse(content: bytes) -> list[dict]:
        lines = list(csv.reader(io.StringIO(content.decode("utf-8-sig"))))[skip_rows:]
        header = lines[0] if lines else []
        return [{"row": r, "name": n, "value": v} for r, line in enumerate(lines[1:]) for n, v in zip(header, line)]

    return parsed(files, parse, "doc string, row int, name string, value string, error string")


def read_csv(spark: SparkSession, path: str, skip_rows: int = 0, pattern: str = "*.csv") -> DataFrame:
    return csv_cells(binary_files(spark, path, pattern), skip_rows)


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict] = []
        self.table, self.row, self.col, self.text = -1, -1, -1, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.row, self.col = self.row + 1, -1
        elif tag in ("td", "th"):
            self.col, self.text = self.col + 1, ""

    def handle_data(self, data):
        if self.text is not None:
            self.text += data

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.text is not None:
            self.rows.append({"table_idx": self.table, "row": self.row, "col": self.col, "value": " ".join(self.text.split())})
            self.text = None


def html_cells(pages: DataFrame, key: str, source: str) -> DataFrame:
    """Cells of the tables in a column of HTML."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, text in zip(batch[key], batch[source]):
                parser = _Tables()
                parser.feed(text or "")
                if parser.rows:
                    yield pd.DataFrame(parser.rows).assign(**{key: k})[[key, "table_idx", "row", "col", "value"]]

    return pages.select(key, source).mapInPandas(run, f"{key} {kind}, table_idx int, row int, col int, value string")
