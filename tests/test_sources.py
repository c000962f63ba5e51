"""Documents made on the fly are read, rewritten and reported."""

import zipfile

from pyspark.sql import functions as F

from calyx.operators import windows
from calyx.sources import config, documents, pdf, sinks

_PZFX = """<GraphPadPrismFile><Table ID="T1"><Title>40-49岁GMC</Title>
<YColumn><Subcolumn><d>100</d><d>200</d></Subcolumn><Subcolumn><d>150</d><d>250</d></Subcolumn></YColumn>
<YColumn><Subcolumn><d>1</d></Subcolumn></YColumn></Table><Table ID="T2"><Title>other</Title></Table></GraphPadPrismFile>"""


def _zip(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("one") + "<w:p/>" + p("表 1") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    _zip(tmp_path / "a.docx", {"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"})
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    rows = documents.read_docx(spark, str(tmp_path)).collect()
    assert [r.text for r in sorted((r for r in rows if r.kind == "paragraph"), key=lambda r: r.idx)] == ["one", "", "表 1"]
    assert [(r.row, r.col, r.text, r.title) for r in rows if r.kind == "cell"] == [(0, 0, "a", "表 1"), (0, 1, "b", "表 1")]
    assert [r.doc.endswith("bad.docx") for r in rows if r.error] == [True]
    assert documents.docx_text(spark, str(tmp_path)).first().text == "one\n\n表 1"


def test_xlsx_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None), (2, "=Data!A1", 2.5)], "id int, name string, v double")
    path = str(tmp_path / "r.xlsx")
    sinks.write_xlsx({"all": df, "none": df.limit(0)}, path)
    cells = {(r.sheet, r.row, r.col): r.value for r in documents.read_xlsx(spark, str(tmp_path)).collect()}
    assert cells["all", 1, 1] == "id" and cells["all", 2, 2] == "x" and cells["all", 3, 3] == "2.5" and cells["none", 1, 3] == "v"
    text = {r.sheet: r.text for r in documents.xlsx_text(documents.read_xlsx(spark, str(tmp_path))).collect()}
    assert text["none"] == "id\tname\tv" and not (tmp_path / "r.xlsx.part").exists()


def test_pptx(spark, tmp_path):
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    sp = lambda t, ph="": f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda body: f"<p:sld {ns}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://x/hyperlink" Target="https://a.b/c"/></Relationships>'
    _zip(tmp_path / "s.pptx", {"ppt/slides/slide2.xml": slide(sp("second")), "ppt/slides/slide1.xml": slide(sp("Title", '<p:ph type="title"/>') + sp("body")), "ppt/slides/_rels/slide1.xml.rels": rels})
    rows = sorted(documents.read_pptx(spark, str(tmp_path)).collect(), key=lambda r: r.slide_idx)
    assert [(r.title, r.text, r.shape_count, r.links) for r in rows] == [("Title", "Title\nbody", 2, ["https://a.b/c"]), (None, "second", 1, [])]
    assert [r.link for r in documents.pptx_links(documents.read_pptx(spark, str(tmp_path))).collect()] == ["https://a.b/c"]


def test_pzfx(spark, tmp_path):
    (tmp_path / "p.pzfx").write_text(_PZFX, encoding="utf-8")
    _zip(tmp_path / "z.pzfx", {"x.xml": _PZFX})
    rows = documents.read_pzfx(spark, str(tmp_path)).where("y = 0").collect()
    assert sorted((r.sub, r.row, r.value) for r in rows if r.doc.endswith("p.pzfx")) == [(0, 0, "100"), (0, 1, "200"), (1, 0, "150"), (1, 1, "250")]
    assert {r.age_band for r in rows} == {"40-49岁"} and len(rows) == 8
    for name in ("p.pzfx", "z.pzfx"):
        new = sinks.rewritten_pzfx((tmp_path / name).read_bytes(), "T1", {(0, 0, 1): "7 & 8", (1, 0, 0): None})
        (tmp_path / name).write_bytes(new)
    values = documents.read_pzfx(spark, str(tmp_path)).where("y = 0 and sub = 0 and row = 1 or y = 1").collect()
    assert sorted(r.value for r in values) == ["1", "1", "7 & 8", "7 & 8"]


def test_text_csv_listing(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("中文".encode("gbk"))
    (tmp_path / "b.txt").write_bytes("﻿plain".encode())
    (tmp_path / "~$b.txt").write_bytes(b"lock")
    (tmp_path / "c.csv").write_bytes("﻿skip\nh1,h2\n1,2\n".encode())
    got = {r.doc.rsplit("/", 1)[1]: r.text for r in documents.read_text(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "中文" and got["b.txt"] == "plain"
    assert [(r.name, r.value) for r in documents.read_csv(spark, str(tmp_path), skip_rows=1).collect()] == [("h1", "1"), ("h2", "2")]
    assert [r.name for r in documents.listed(spark, str(tmp_path), (".TXT",)).collect()] == ["a.txt", "b.txt"]


def test_rules_from_yaml(spark):
    text = "defaults: {sheet: S, cell: A1}\nrules:\n- {name: r, search: {keyword: k, page: 2}, excel: {cell: B2}}\n- {name: q, search: {page: 1}}\n"
    assert [tuple(r) for r in config.rule_table(spark, text).collect()] == [(0, "r", "k", 2, "S", "B2", None), (1, "q", None, 1, "S", "A1", None)]


def test_hooks(spark):
    pages = spark.createDataFrame([("d", "x" * 60, "c1"), ("e", "short", "c2")], "doc string, text string, content string")
    got = {r.doc: (r.text, r.origin) for r in config.with_fallback_text(pages, "text", lambda s: s + "!", "content").collect()}
    assert got["d"][1] == "text" and got["e"] == ("c2!", "recognised")

    def client():
        def ask(text):
            if text == "short":
                raise ValueError("no")
            return text[:1]
        return ask

    answers = {r.doc: (r.answer, r.error) for r in config.extracted(pages, "doc", "text", client).collect()}
    assert answers == {"d": ("x", None), "e": (None, "ValueError: no")}


def test_a_workbook_is_made_or_amended(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    cells = spark.createDataFrame([("A", 1, 1, "x"), ("A", 1, 1, "y"), ("B:?", 2, 3, "=A!A1"), ("A", 0, 1, "no")], "sheet string, row int, col int, value string")
    sinks.write_cells(cells, path)
    sinks.write_cells(cells.limit(1).withColumn("row", F.lit(4)), path)
    got = {(r.sheet, r.row, r.col): r.value for r in documents.read_xlsx(spark, str(tmp_path)).collect()}
    assert got["A", 1, 1] == "y" and got["A", 4, 1] in ("x", "y") and ("B__", 2, 3) in got and len(got) == 3
    assert [p.name for p in tmp_path.iterdir()] == ["w.xlsx"]


def test_pdf_pages_and_tables(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(pdf.simple_pdf([["One (two) \\ three", "报告 😀"], []], [None, [["a", "b"], ["c d", ""]]]))
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    rows = {(r.doc.rsplit("/", 1)[-1], r.page): (r.text, r.error) for r in pdf.read_pdf(spark, str(tmp_path)).collect()}
    assert rows["a.PDF", 1] == ("One (two) \\ three\n报告 😀", None) and rows["bad.pdf", None][1] and len(rows) == 3
    cells = sorted((r.page, r.table_idx, r.row, r.col, r.text) for r in pdf.read_pdf_tables(spark, str(tmp_path)).where("error is null").collect())
    assert cells == [(2, 0, 0, 0, "a"), (2, 0, 0, 1, "b"), (2, 0, 1, 0, "c d"), (2, 0, 1, 1, "")]
    assert pdf.read_pdf(spark, str(tmp_path), [9]).where("error is null").count() == 0


def test_pdf_syntax():
    old = b"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R] /MediaBox [0 0 200 100] >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Contents [4 0 R] /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 >> >> >> >> endobj
4 0 obj << /Length 200 >> stream
BT /F1 10 Tf 14 TL 10 80 Td (caf\\351) Tj T* [(A) -300 (B) 20 (C)] TJ (next) ' ET q 2 0 0 2 0 0 cm BT /F1 5 Tf 50 40 Td (right) Tj ET Q
endstream endobj"""
    found = list(pdf._each(old.replace(b"\\\\", b"\\"), None, {}))
    assert [(n, pdf.page_text(f.strings)) for n, f in found] == [(1, "café right\nA BC\nnext")]


def test_calls_are_tried_again_only_where_it_may_help(spark):
    def make():
        calls = []

        def call(text):
            calls.append(text)
            if text == "busy" and calls.count(text) < 3:
                raise config.ServiceError(503)
            if text in ("bad", "down"):
                raise config.ServiceError(400 if text == "bad" else 500)
            return text.upper()

        return call

    df = spark.createDataFrame([(1, "busy"), (2, "bad"), (3, "down"), (4, "ok")], "k int, t string").coalesce(1)
    got = {r.k: (r.answer, r.error, r.calls) for r in config.extracted(df, "k", "t", make, retries=2, wait=0.0).collect()}
    assert got == {1: ("BUSY", None, 3), 2: (None, "ServiceError: 400", 1), 3: (None, "ServiceError: 500", 3), 4: ("OK", None, 1)}


def test_marker_groups(spark):
    header = spark.createDataFrame([("d", 0, "Sample"), ("d", 1, "Anti HBs"), ("d", 2, "note"), ("d", 3, "anti-hcv"), ("d", 4, None)], "doc string, c int, t string")
    got = sorted(tuple(r) for r in windows.marker_groups(header, ["doc"], "c", "t", {"antihbs": "HBs", "anti-HCV": "HCV"}, F.lit(5)).collect())
    assert got == [("d", "HBs", 1, 3), ("d", "HCV", 3, 5)]
