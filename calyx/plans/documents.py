"""Queries of the document sources and sinks: every supplier becomes a small file, made and read back in the workers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx.operators import windows
from calyx.runtime import table
from calyx.sources import config, documents, pdf, sinks

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _files(spark: SparkSession, d: str, make: Callable[[int, str, str], bytes]) -> DataFrame:
    """``path, content``: one file per supplier, made of its key, name and phone."""

    @F.pandas_udf("binary")
    def content(key: pd.Series, name: pd.Series, phone: pd.Series) -> pd.Series:
        return pd.Series([make(k, n or "", p or "") for k, n, p in zip(key, name, phone)])

    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", F.format_string("%s-%d", F.lit("tel"), "s_nationkey").alias("phone"))
    return rows.select(F.col("s_suppkey").cast("string").alias("path"), content("s_suppkey", "s_name", "phone").alias("content"))


def _pdf(key: int, name: str, phone: str) -> bytes:
    return pdf.simple_pdf([[name, phone], [f"page two of {key}"]], [None, [["name", name], ["phone", phone]]], key % 2 == 0)


def _docx(key: int, name: str, phone: str) -> bytes:
    p = lambda t: f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    grid = f"<w:tbl><w:tr><w:tc>{p(name)}</w:tc><w:tc>{p(phone)}</w:tc></w:tr></w:tbl>"
    end = "</w:document>" if key % 2 else ""  # every other file is cut off
    return _zip({"word/document.xml": f"<w:document {_W}><w:body>{p('first')}<w:p/>{p('表 ' + str(key))}{grid}</w:body>{end}"})


def _pptx(key: int, name: str, phone: str) -> bytes:
    cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></a:txBody></a:tc>"
    grid = f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>{cell(name)}{cell(phone)}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    rels = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://x/hyperlink" Target="https://a.b/{key % 7}"/></Relationships>'
    return _zip({"ppt/slides/slide1.xml": f"<p:sld {_A}><p:cSld><p:spTree>{grid}</p:spTree></p:cSld></p:sld>", "ppt/slides/_rels/slide1.xml.rels": rels})


def _pzfx(key: int, name: str, phone: str) -> bytes:
    text = f'<GraphPadPrismFile><Table ID="T{key}"><Title>40-49岁GMC</Title><YColumn><Subcolumn><d>{key}</d><d>{key * 2}</d></Subcolumn></YColumn></Table></GraphPadPrismFile>'
    return _zip({"x.xml": text}) if key % 2 else text.encode()


def s1_pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    return pdf.pdf_pages(_files(spark, d, _pdf), [1], {1: [[0, 47, 600, 60]]}).select("doc", "page", "text", "error")


def s2_pdf_cells(spark: SparkSession, d: str) -> DataFrame:
    return pdf.pdf_cells(_files(spark, d, _pdf), near_keyword="page two").select("doc", "page", "table_idx", "row", "col", "text")


def s4_docx_rows(spark: SparkSession, d: str) -> DataFrame:
    """Cells with the title above, and one error for each file that is cut off."""
    found = documents.docx_rows(_files(spark, d, _docx))
    return found.where("kind = 'cell' or error is not null").select("doc", "row", "col", "text", "title", F.col("error").isNotNull().alias("failed"))


def s5_docx_text(spark: SparkSession, d: str) -> DataFrame:
    return documents.docx_fast(_files(spark, d, _docx)).select("doc", "text", "way")


def s6_pzfx_values(spark: SparkSession, d: str) -> DataFrame:
    return documents.pzfx_rows(_files(spark, d, _pzfx)).select("doc", "table_id", "age_band", "metric", "row", "value")


def s7_zip_files(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d, _pzfx).select("path", documents.is_zip(F.col("content")).alias("zipped"))


def s8_decoded_text(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d, lambda key, name, phone: f"名称 {name}".encode("gbk" if key % 2 else "utf-8-sig"))
    return documents.text_files(files).select("doc", "text", "encoding")


def s9_sheet_text(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d, lambda key, name, phone: sinks.workbook({"data": [["name", None, name], [], ["phone", None, phone]]}))
    return documents.xlsx_text(documents.xlsx_cells(files)).select("doc", "sheet", "text")


def s10_csv_cells(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d, lambda key, name, phone: f"﻿notes\nname,phone\n{name},{phone}\n".encode())
    return documents.csv_cells(files, 1).select("doc", "row", "name", "value")


def s12_slide_cells(spark: SparkSession, d: str) -> DataFrame:
    return documents.pptx_cells(_files(spark, d, _pptx)).select("doc", "slide_idx", "row", "col", "text")


def s13_slide_links(spark: SparkSession, d: str) -> DataFrame:
    return documents.pptx_links(documents.pptx_slides(_files(spark, d, _pptx)))


def s20_answers(spark: SparkSession, d: str) -> DataFrame:
    """A service that is busy at the first call of every third text and refuses every fifth."""

    def make():
        asked: dict[str, int] = {}

        def call(text: str) -> str:
            asked[text] = asked.get(text, 0) + 1
            key = int(text)
            if key % 5 == 0:
                raise config.ServiceError(400)
            if key % 3 == 0 and asked[text] == 1:
                raise config.ServiceError(429)
            return f"answer {key}"

        return call

    texts = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("t"))
    return config.extracted(texts, "s_suppkey", "t", make, wait=0.0)


def k3_amended_cells(spark: SparkSession, d: str) -> DataFrame:
    """A workbook in which one cell is set and a sheet is added; the other cells stay."""
    make = lambda key, name, phone: sinks.amended(sinks.workbook({"data": [["name", name], ["phone", "old"]]}), {"data": {(2, 2): phone}, "more": {(3, 1): key}})
    return documents.xlsx_cells(_files(spark, d, make)).select("doc", "sheet", "row", "col", "value")


def k9_rewritten_values(spark: SparkSession, d: str) -> DataFrame:
    make = lambda key, name, phone: sinks.rewritten_pzfx(_pzfx(key, name, phone), f"T{key}", {(0, 0, 1): "7"})
    return documents.pzfx_rows(_files(spark, d, make)).select("doc", "row", "value")


def f6_marker_groups(spark: SparkSession, d: str) -> DataFrame:
    """The flags of an order's lines as the cells of its header row; three spellings name two markers."""
    cells = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.concat_ws(" ", "l_returnflag", "l_tax")).alias("text"))
    return windows.marker_groups(cells, ["l_orderkey"], "l_linenumber", "text", {"R0.01": "low", "A0.01": "low", "r0.05": "high"}, F.lit(8))


def e4_blueprint(spark: SparkSession, d: str) -> DataFrame:
    """Slides per slot of a blueprint whose rules are a table."""
    text = """
chapters:
  - {id: 1, title: Context, slots: [{slot: 1, match: {title_any: [Design, 设计]}}, {slot: 2, match: {title_any: [Overview, 概览]}, tie: max_shape_count}]}
  - {id: 2, title: Safety, slots: [{slot: 3, match: {title_any: [Safety, 安全]}}]}
"""
    rules = config.blueprint_table(spark, text).select("chapter", "slot", "tie", F.explode("phrases").alias("phrase"))
    words = [r[0] for r in rules.select("phrase").distinct().collect()]  # the blueprint's own phrases
    titles = table(spark, d, "slide_info").where("title is not null").select("global_id", "title").distinct()
    hits = F.array_compact(F.array(*[F.when(F.col("title").contains(w), F.lit(w)) for w in sorted(words)]))
    found = titles.select("global_id", F.explode(hits).alias("phrase")).join(F.broadcast(rules), "phrase")
    counted = found.groupBy("chapter", "slot", "tie").agg(F.count_distinct("global_id").alias("slides"))
    return rules.select("chapter", "slot", "tie").distinct().join(counted, ["chapter", "slot", "tie"], "left").na.fill(0, ["slides"])


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[0] in "ksfe" and n[1].isdigit()}

_S = "WITH s AS (SELECT s_suppkey::VARCHAR AS doc, s_suppkey AS k, s_name AS name, concat('tel-', s_nationkey) AS phone FROM supplier)"
SQL = {
    "s1_pdf_pages": f"{_S} SELECT doc, 1 AS page, name AS text, NULL::VARCHAR AS error FROM s",
    "s2_pdf_cells": f"{_S} SELECT doc, 2 AS page, 0 AS table_idx, c.row, c.col, CASE WHEN c.row = 0 AND c.col = 0 THEN 'name' WHEN c.row = 0 THEN name WHEN c.col = 0 THEN 'phone' ELSE phone END AS text FROM s, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(row, col)",
    "s4_docx_rows": f"{_S} SELECT doc, 0 AS row, c.col, CASE c.col WHEN 0 THEN name ELSE phone END AS text, concat('表 ', k) AS title, false AS failed FROM s, (VALUES (0), (1)) c(col) WHERE k % 2 = 1 UNION ALL SELECT doc, NULL, NULL, NULL, NULL, true FROM s WHERE k % 2 = 0",
    "s5_docx_text": f"{_S} SELECT doc, concat('first', chr(10), '表 ', k, chr(10), name, chr(10), phone) AS text, CASE WHEN k % 2 = 1 THEN 'fast' ELSE 'fallback' END AS way FROM s",
    "s6_pzfx_values": f"{_S} SELECT doc, concat('T', k) AS table_id, '40-49岁' AS age_band, 'GMC' AS metric, c.row, (k * (c.row + 1))::VARCHAR AS value FROM s, (VALUES (0), (1)) c(row)",
    "s7_zip_files": f"{_S} SELECT doc AS path, k % 2 = 1 AS zipped FROM s",
    "s8_decoded_text": f"{_S} SELECT doc, concat('名称 ', name) AS text, CASE WHEN k % 2 = 1 THEN 'gbk' ELSE 'utf-8-sig' END AS encoding FROM s",
    "s9_sheet_text": f"{_S} SELECT doc, 'data' AS sheet, concat('name', chr(9), name, chr(10), 'phone', chr(9), phone) AS text FROM s",
    "s10_csv_cells": f"{_S} SELECT doc, 0 AS row, 'name' AS name, name AS value FROM s UNION ALL SELECT doc, 0, 'phone', phone FROM s",
    "s12_slide_cells": f"{_S} SELECT doc, 0 AS slide_idx, 0 AS row, 0 AS col, name AS text FROM s UNION ALL SELECT doc, 0, 0, 1, phone FROM s",
    "s13_slide_links": f"{_S} SELECT doc, concat('https://a.b/', k % 7) AS link FROM s",
    "s20_answers": "SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN concat('answer ', s_suppkey) END AS answer, CASE WHEN s_suppkey % 5 = 0 THEN 'ServiceError: 400' END AS error, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS calls FROM supplier",
    "k3_amended_cells": f"{_S} SELECT doc, 'data' AS sheet, c.row, c.col, CASE WHEN c.row = 1 AND c.col = 1 THEN 'name' WHEN c.row = 1 THEN name WHEN c.col = 1 THEN 'phone' ELSE phone END AS value FROM s, (VALUES (1, 1), (1, 2), (2, 1), (2, 2)) c(row, col) UNION ALL SELECT doc, 'more', 3, 1, k::VARCHAR FROM s",
    "k9_rewritten_values": f"{_S} SELECT doc, 0 AS row, k::VARCHAR AS value FROM s UNION ALL SELECT doc, 1, '7' FROM s",
    "f6_marker_groups": """WITH c AS (SELECT l_orderkey, l_linenumber, min(concat(l_returnflag, ' ', l_tax)) AS t FROM lineitem GROUP BY 1, 2), m AS (SELECT *, CASE WHEN t IN ('R 0.01', 'A 0.01') THEN 'low' WHEN t = 'R 0.05' THEN 'high' END AS marker FROM c)
        SELECT l_orderkey, marker, l_linenumber AS first, coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 8) AS until FROM m WHERE marker IS NOT NULL""",
    "e4_blueprint": """WITH r(chapter, slot, tie, phrase) AS (VALUES ('1', 1, 'first', 'Design'), ('1', 1, 'first', '设计'), ('1', 2, 'max_shape_count', 'Overview'), ('1', 2, 'max_shape_count', '概览'), ('2', 3, 'first', 'Safety'), ('2', 3, 'first', '安全'))
        SELECT chapter, slot, tie, count(DISTINCT global_id) AS slides FROM r LEFT JOIN slide_info s ON contains(s.title, r.phrase) GROUP BY 1, 2, 3""",
}
