"""Reports: placed cells, workbooks, CSV, JSON and text, written atomically by Spark or the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Mapping, Sequence
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx import runtime
from calyx.functions.identifiers import cell_address, column_letters
from calyx.functions.texts import cell_text

#: A workbook is made on the driver: beyond so many cells it is refused.
MAX_CELLS = 500_000


def placed(table: DataFrame, start: str, row: str, col: str, value: str) -> DataFrame:
    """``row, col, value`` of a table's cells shifted to a start address, texts cut to what a cell holds."""
    at = cell_address(F.lit(start))
    return table.select((F.col(row) + at["row"]).alias("row"), (F.col(col) + at["col"]).alias("col"), cell_text(F.col(value).cast("string")).alias("value"))


def grouped_cells(rows: DataFrame, group: Column, values: Sequence[Column], bases: Sequence[int], row: Column) -> DataFrame:
    """The values of group g side by side from column ``bases[g]``."""
    base = F.get(F.array(*[F.lit(b) for b in bases]), group)
    return rows.select(row.alias("row"), F.posexplode(F.array(*[v.cast("string") for v in values])).alias("_i", "value"), base.alias("_b")).select("row", (F.col("_b") + F.col("_i")).alias("col"), "value")


def formula_links(cells: DataFrame, sheet: str) -> DataFrame:
    """Cells that hold a link to the same place of another sheet."""
    return cells.select("row", "col", F.concat(F.lit(f"='{sheet}'!"), column_letters(F.col("col")), F.col("row").cast("string")).alias("value"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def not_yet_done(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without an output: what a run without overwriting has left to do."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def text_report(rows: DataFrame, section: str, item: str, line: Column) -> DataFrame:
    """One text per section: its items in order, each with its lines in order. Sections are folders or files of a report."""
    items = rows.groupBy(section, item).agg(F.array_join(F.sort_array(F.collect_set(line)), "\n  ").alias("lines"))
    blocks = items.groupBy(section).agg(F.sort_array(F.collect_list(F.concat(F.col(item), F.lit("\n  "), F.col("lines")))).alias("b"))
    return blocks.select(section, F.concat(F.lit("["), F.col(section), F.lit("]\n"), F.array_join("b", "\n")).alias("report"))


_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def workbook(sheets: Mapping[str, Sequence[Sequence]]) -> bytes:
    """A workbook of named sheets, each a list of rows."""
    parts: dict[str, str] = {}
    names = []
    for n, (name, rows) in enumerate(sheets.items(), 1):
        lines = []
        for r, row in enumerate(rows, 1):
            cells = "".join(_cell(r, c, v) for c, v in enumerate(row, 1) if v is not None)
            lines.append(f'<row r="{r}">{cells}</row>')
        parts[f"xl/worksheets/sheet{n}.xml"] = f'<worksheet xmlns="{_SHEET}"><sheetData>{"".join(lines)}</sheetData></worksheet>'
        names.append((n, _sheet_name(name)))
    sheet_list = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{n}" r:id="rId{n}"/>' for n, name in names)
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_SHEET}" xmlns:r="{_OFFICE}"><sheets>{sheet_list}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{_PACKAGE}">' + "".join(f'<Relationship Id="rId{n}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n, _ in names) + "</Relationships>"
    parts["_rels/.rels"] = f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{_KIND}.worksheet+xml"/>' for n, _ in names)
    parts["[Content_Types].xml"] = f'<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/>' + kinds + "</Types>"
    return _zipped({name: ('<?xml version="1.0" encoding="UTF-8"?>' + text).encode() for name, text in parts.items()})


def _sheet_name(name: str) -> str:
    return re.sub(r"[\\/*?:\[\]]", "_", name)[:31]


def _zipped(parts: Mapping[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    with zipfile.ZipFile(out) as z:
        if z.testzip() is not None:
            raise OSError("the workbook does not read back")
    return out.getvalue()


def write_xlsx(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook of named tables, each with its header; written beside the target and moved there when complete."""
    held: dict[str, list] = {}
    spark = None
    for name, df in sheets.items():
        spark = df.sparkSession
        width = max(1, len(df.columns))
        rows = df.limit(MAX_CELLS // width + 1).collect()
        if len(rows) * width > MAX_CELLS:
            raise ValueError(f"sheet {name} has more than {MAX_CELLS} cells")
        held[name] = [df.columns, *rows]
    runtime.write_bytes(spark or SparkSession.getActiveSession(), path, workbook(held))


def amended(content: bytes | None, cells: Mapping[str, Mapping[tuple[int, int], object]]) -> bytes:
    """A workbook with cells (row, column from 1) set by sheet; None makes a new one.

    Sheets that are missing are added at the end. All else of a workbook stays as it is.
    """
    if content is None:
        return amended(workbook({name: [] for name in cells} or {"Sheet": []}), cells)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = {item.filename: z.read(item.filename) for item in z.infolist()}
    for prefix, uri in (("", _SHEET), ("r", _OFFICE)):
        ET.register_namespace(prefix, uri)
    book, links = ET.fromstring(parts["xl/workbook.xml"]), ET.fromstring(parts["xl/_rels/workbook.xml.rels"])
    target = {r.get("Id"): r.get("Target").removeprefix("/xl/") for r in links}
    place = {s.get("name"): "xl/" + target[s.get(f"{{{_OFFICE}}}id")] for s in book.iter(f"{{{_SHEET}}}sheet")}
    for name, values in cells.items():
        known = _sheet_name(name)
        if known not in place:
            place[known] = _add_sheet(parts, book, links, known)
        parts[place[known]] = _set_cells(parts[place[known]], values)
    return _zipped(parts)


def _add_sheet(parts: dict[str, bytes], book: ET.Element, links: ET.Element, name: str) -> str:
    number = 1 + max((int(n) for n in re.findall(r"xl/worksheets/sheet(\d+)\.xml", " ".join(parts))), default=0)
    key = f"rIdNew{number}"
    sheets = book.find(f"{{{_SHEET}}}sheets")
    ids = [int(s.get("sheetId")) for s in sheets]
    ET.SubElement(sheets, f"{{{_SHEET}}}sheet", {"name": name, "sheetId": str(max(ids, default=0) + 1), f"{{{_OFFICE}}}id": key})
    ET.SubElement(links, f"{{{_PACKAGE}}}Relationship", {"Id": key, "Type": f"{_OFFICE}/worksheet", "Target": f"worksheets/sheet{number}.xml"})
    kinds = ET.fromstring(parts["[Content_Types].xml"])
    ET.SubElement(kinds, f"{{{_TYPES}}}Override", {"PartName": f"/xl/worksheets/sheet{number}.xml", "ContentType": f"{_KIND}.worksheet+xml"})
    parts["xl/workbook.xml"], parts["xl/_rels/workbook.xml.rels"], parts["[Content_Types].xml"] = map(_text, (book, links, kinds))
    part = f"xl/worksheets/sheet{number}.xml"
    parts[part] = f'<worksheet xmlns="{_SHEET}"><sheetData/></worksheet>'.encode()
    return part


def _text(root: ET.Element) -> bytes:
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def _set_cells(sheet: bytes, values: Mapping[tuple[int, int], object]) -> bytes:
    root = ET.fromstring(sheet)
    data = root.find(f"{{{_SHEET}}}sheetData")
    rows = {int(r.get("r")): r for r in data}
    for (row, col), value in sorted(values.items()):
        line = rows.get(row)
        if line is None:
            line = rows[row] = ET.Element(f"{{{_SHEET}}}row", {"r": str(row)})
            data.insert(sum(1 for r in data if int(r.get("r")) < row), line)
        new = ET.fromstring(f'<x xmlns="{_SHEET}">{_cell(row, col, value)}</x>')[0] if value is not None else None
        old = next((c for c in line if c.get("r") == f"{_column(col)}{row}"), None)
        at = list(line).index(old) if old is not None else sum(1 for c in line if _number(c.get("r")) < col)
        if old is not None:
            if new is not None and old.get("s"):
                new.set("s", old.get("s"))  # the style stays
            line.remove(old)
        if new is not None:
            line.insert(at, new)
    return _text(root)


def _column(n: int) -> str:
    letters = ""
    while n:
        n, rest = divmod(n - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def _number(address: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", address)[0]:
        n = n * 26 + ord(letter) - 64
    return n


def write_cells(cells: DataFrame, path: str) -> None:
    """Set cells ``sheet, row, col, value`` in the workbook at a path, which is made if it is missing.

    Of a cell given twice the larger value counts. Beyond the cells a workbook may hold it is refused.
    """
    spark = cells.sparkSession
    one = cells.where("row > 0 and col > 0").groupBy("sheet", "row", "col").agg(F.max("value").alias("value")).limit(MAX_CELLS + 1).collect()
    if len(one) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    by_sheet: dict[str, dict] = {}
    for sheet, row, col, value in one:
        by_sheet.setdefault(sheet, {})[row, col] = value
    runtime.write_bytes(spark, path, amended(runtime.read_bytes(spark, path), by_sheet))


def _cell(row: int, col: int, value) -> str:
    letters = _column(col)
    if isinstance(value, bool):
        return f'<c r="{letters}{row}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f'<c r="{letters}{row}"><v>{value}</v></c>'
    text = str(value)
    text = text if len(text) <= 32_000 else text[:31_997] + "..."
    text = re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "", text)
    if text.startswith("=") and len(text) > 1:
        return f'<c r="{letters}{row}"><f>{escape(text[1:])}</f></c>'
    return f'<c r="{letters}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def rewritten_pzfx(content: bytes, table_id: str, values: dict[tuple[int, int, int], str | None]) -> bytes:
    """A graph file with the values (y column, subcolumn, row) of one table replaced; null keeps the old value.

    Only the text of the cells changes. A zipped file is rewritten part by part.
    """
    if content[:4] == b"PK\x03\x04":
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
            for item in old.infolist():
                data = old.read(item.filename)
                new.writestr(item, rewritten_pzfx(data, table_id, values) if item.filename.endswith(".xml") else data)
        return out.getvalue()
    text = content.decode("utf-8")
    table = re.search(rf'<Table\b[^>]*\bID="{re.escape(table_id)}".*?</Table>', text, re.DOTALL)
    if not table:
        return content

    def column(y: int, block: str) -> str:
        count = -1

        def subcolumn(match: re.Match) -> str:
            nonlocal count
            count += 1
            row, sub = -1, count

            def cell(m: re.Match) -> str:
                nonlocal row
                row += 1
                value = values.get((y, sub, row))
                return m.group(0) if value is None else f"{m.group(1)}{escape(value)}{m.group(3)}"

            return re.sub(r"(<d\b[^>]*>)(.*?)(</d>)", cell, match.group(0), flags=re.DOTALL)

        return re.sub(r"<Subcolumn\b.*?</Subcolumn>", subcolumn, block, flags=re.DOTALL)

    at = -1

    def y_column(match: re.Match) -> str:
        nonlocal at
        at += 1
        return column(at, match.group(0))

    new = re.sub(r"<YColumn\b.*?</YColumn>", y_column, table.group(0), flags=re.DOTALL)
    return (text[: table.start()] + new + text[table.end() :]).encode("utf-8")
