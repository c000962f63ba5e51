"""Queries of sinks, listings and event windows, as the tables that would be written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx.operators.keyed import filled
from calyx.sources import config, documents, sinks
from calyx.streaming import events
from calyx.operators import sets
from calyx.runtime import table


def k1_placed_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "nation").select(F.col("n_nationkey").alias("r"), F.posexplode(F.array("n_name", F.col("n_regionkey").cast("string"))).alias("c", "v"))
    return sinks.placed(cells, "B3", "r", "c", "v")


def k4_report_sheets(spark: SparkSession, d: str) -> DataFrame:
    """The sheets of a report - all, failed, summary - as one table."""
    rows = table(spark, d, "pdf_file").select("folder", "file_id", "error").distinct()
    summary = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"))
    return sets.sheets({"all": rows.drop("error"), "failed": rows.where("error is not null").drop("error"), "summary": summary}, ["a", "b"])


def k6_json_rows(spark: SparkSession, d: str) -> DataFrame:
    return sets.json_rows(table(spark, d, "supplier"), ["s_suppkey", "s_name"]).select("s_suppkey", F.md5("json").alias("json"))


def k7_text_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_nationkey")
    return sinks.text_report(rows, "r_name", "n_name", F.concat(F.lit("key "), F.col("n_nationkey").cast("string")))


def k8_group_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_linenumber <= 5").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("mean"), F.max("l_suppkey").alias("upper"), F.min("l_suppkey").alias("lower"))
    return sinks.grouped_cells(rows, F.col("l_linenumber") - 1, [F.col("mean"), F.col("upper"), F.col("lower")], [2, 5, 8, 11, 14], F.col("l_orderkey"))


def k8b_wide_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers side by side, one row per sample; the markers are a fixed list, so the pivot needs no scan."""
    from calyx.functions.identifiers import MARKERS, marker

    rows = table(spark, d, "serology_row").where("sample is not null").select("sample", marker(F.col("marker")).alias("m"), filled(F.col("value")).alias("v"))
    return rows.groupBy("sample").pivot("m", list(MARKERS)).agg(F.max("v"))


def k11_left_to_do(spark: SparkSession, d: str) -> DataFrame:
    inputs = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    return sinks.not_yet_done(inputs, table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key")), "key")


def k12_rename_plan(spark: SparkSession, d: str) -> DataFrame:
    """Proposed names whose target does not exist yet."""
    files = table(spark, d, "pdf_file").select("file_id", F.lower(F.regexp_replace(F.trim("name"), r"[^A-Za-z0-9.]+", "_")).alias("target"), "folder").distinct()
    return sets.rename_plan(files, "target", table(spark, d, "pdf_file"), "name").select("file_id", "target")


def k13_formula_links(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "part").select(F.col("p_size").alias("row"), ((F.col("p_partkey") % 800) + 1).cast("int").alias("col")).distinct()
    return sinks.formula_links(cells, "Data")


def s11_html_cells(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "nation").selectExpr("n_nationkey", "concat('<p>x</p><table><tr><th>name</th><th>k</th></tr><tr><td> ', n_name, ' </td><td><b>', n_regionkey, '</b></td></tr></table>') AS html")
    return documents.html_cells(pages, "n_nationkey", "html")


def s17_box_forms(spark: SparkSession, d: str) -> DataFrame:
    return config.box_table(spark, '{"1": [[0, 0, 10, 20], [5, 5, 6, 6]], "3": {"rotation": 90, "width": 595.0, "height": 842.0, "boxes": [[1, 2, 3, 4]]}}')


def s18_parsed_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "customer").selectExpr("c_custkey", "CASE c_custkey % 3 WHEN 0 THEN concat('  TCP    10.0.0.1:', c_custkey, '   93.184.', c_custkey % 200, '.34:443   ESTABLISHED') WHEN 1 THEN concat('  192.168.1.', c_custkey % 250, '    3C-22-FB-00-00-', c_custkey % 90 + 10, '   dynamic') ELSE 'header' END AS line")
    tcp = config.parsed_connections(lines, "line").groupBy("remote", "state").agg(F.count(F.lit(1)).alias("n")).select(F.col("remote").alias("address"), F.col("state").alias("detail"), "n")
    arp = config.parsed_arp(lines, "line").groupBy("ip", "mac").agg(F.count(F.lit(1)).alias("n")).select(F.col("ip").alias("address"), F.col("mac").alias("detail"), "n")
    return tcp.unionByName(arp)


def x1_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extra: the streaming window aggregate on a batch."""
    rows = events.windowed(table(spark, d, "events"), "ts", ["event_type"], "1 hour")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def x2_event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Extra: sessions of half an hour per user, as a batch."""
    rows = events.sessions(table(spark, d, "events"), "ts", ["user_id"], "30 minutes")
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[0] in "ksx" and n[1].isdigit()}

_COL = "concat(CASE WHEN col > 702 THEN chr((65 + (col - 703) // 676)::INT) ELSE '' END, CASE WHEN col > 26 THEN chr((65 + ((col - 27) // 26) % 26)::INT) ELSE '' END, chr((65 + (col - 1) % 26)::INT))"
_MARK = "CASE WHEN contains(m, 'anti-hbe') OR contains(m, 'antihbe') THEN 'Anti-HBe' WHEN contains(m, 'hbeag') THEN 'HBeAg' WHEN contains(m, 'hbsag') THEN 'HBsAg' WHEN contains(m, 'anti-hbc') OR contains(m, 'antihbc') THEN 'Anti-HBc' WHEN contains(m, 'anti-hbs') OR contains(m, 'antihbs') THEN 'Anti-HBs' END"
SQL = {
    "k1_placed_cells": "SELECT n_nationkey + 3 AS row, 2 AS col, n_name AS value FROM nation UNION ALL SELECT n_nationkey + 3, 3, n_regionkey::VARCHAR FROM nation",
    "k4_report_sheets": "WITH r AS (SELECT DISTINCT file_id, folder, error FROM pdf_file) SELECT 'all' AS sheet, folder AS a, file_id::VARCHAR AS b FROM r UNION ALL SELECT 'failed', folder, file_id::VARCHAR FROM r WHERE error IS NOT NULL UNION ALL SELECT 'summary', folder, count(*)::VARCHAR FROM r GROUP BY 2",
    "k6_json_rows": "SELECT s_suppkey, md5(concat('{\"s_suppkey\":', s_suppkey, ',\"s_name\":\"', s_name, '\"}')) AS json FROM supplier",
    "k7_text_report": "SELECT r_name, concat('[', r_name, ']', chr(10), string_agg(concat(n_name, chr(10), '  key ', n_nationkey), chr(10) ORDER BY n_name)) AS report FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "k8_group_cells": "WITH r AS (SELECT l_orderkey AS row, l_linenumber AS g, max(l_quantity)::INT AS a, max(l_suppkey) AS b, min(l_suppkey) AS c FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1, 2) SELECT row, g * 3 - 1 AS col, a::VARCHAR AS value FROM r UNION ALL SELECT row, g * 3, b::VARCHAR FROM r UNION ALL SELECT row, g * 3 + 1, c::VARCHAR FROM r",
    "k8b_wide_markers": f"""WITH s AS (SELECT sample, replace(lower(trim(marker)), ' ', '') AS m, nullif(trim(value), '') AS v FROM serology_row WHERE sample IS NOT NULL), r AS (SELECT sample, {_MARK} AS k, v FROM s)
        SELECT sample, """ + ", ".join(f"max(v) FILTER (k = '{m}') AS \"{m}\"" for m in ("Anti-HBs", "HBsAg", "Anti-HBc", "Anti-HBe", "HBeAg")) + " FROM r GROUP BY 1",
    "k11_left_to_do": "SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "k12_rename_plan": r"WITH f AS (SELECT DISTINCT file_id, folder, lower(regexp_replace(trim(name), '[^A-Za-z0-9.]+', '_', 'g')) AS target FROM pdf_file) SELECT file_id, target FROM f WHERE target NOT IN (SELECT name FROM pdf_file WHERE name IS NOT NULL)",
    "k13_formula_links": f"WITH c AS (SELECT DISTINCT p_size AS row, (p_partkey % 800 + 1)::INT AS col FROM part) SELECT row, col, concat('=''Data''!', {_COL}, row) AS value FROM c",
    "s11_html_cells": "SELECT n_nationkey, 0 AS table_idx, 0 AS row, 0 AS col, 'name' AS value FROM nation UNION ALL SELECT n_nationkey, 0, 0, 1, 'k' FROM nation UNION ALL SELECT n_nationkey, 0, 1, 0, n_name FROM nation UNION ALL SELECT n_nationkey, 0, 1, 1, n_regionkey::VARCHAR FROM nation",
    "s17_box_forms": "SELECT 1 AS page, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS top, 10.0::DOUBLE AS x1, 20.0::DOUBLE AS bottom, 0 AS rotation, NULL::DOUBLE AS page_w, NULL::DOUBLE AS page_h UNION ALL SELECT 1, 5, 5, 6, 6, 0, NULL, NULL UNION ALL SELECT 3, 1, 2, 3, 4, 90, 595, 842",
    "s18_parsed_lines": "SELECT concat('93.184.', c_custkey % 200, '.34') AS address, 'ESTABLISHED' AS detail, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1 UNION ALL SELECT concat('192.168.1.', c_custkey % 250), concat('3c:22:fb:00:00:', c_custkey % 90 + 10), count(*) FROM customer WHERE c_custkey % 3 = 1 GROUP BY 1, 2",
    "x1_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('hour', ts), event_type",
    "x2_event_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS x FROM events), s AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
}
