"""Queries of the order-dependent operators, graphs and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx import runtime
from calyx.operators import graph, keyed, sets, windows
from calyx.runtime import table

_ORD = ["ts", "event_id"]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def w1_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    heading = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return rows.select("event_id", windows.forward_filled(heading, ["user_id"], _ORD).alias("heading"))


def w3_column_spans(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber").distinct()
    return starts.select("l_orderkey", "l_linenumber", windows.span_end(F.col("l_linenumber"), ["l_orderkey"], ["l_linenumber"], F.lit(8)).alias("until"))


def w4_tie_break(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "slide_info").select("global_id", "source_path", "source_index", F.coalesce("text_content", F.lit("")).alias("text"), "shape_count", "has_table").distinct()
    modes = F.array(*[F.lit(m) for m in ("first", "max_shape_count", "N=64", "N=32", "has_table", "max_text_len")])
    rows = rows.withColumn("mode", F.element_at(modes, (F.pmod(F.length("source_path"), F.lit(6)) + 1).cast("int"))).withColumn("ord", F.struct("source_index", "global_id"))
    return windows.tie_break(rows, "source_path", "mode").select("source_path", "mode", "global_id")


def w5_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("start", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("end", F.col("start") + 1_800_000_000)
    merged = windows.islands(rows, ["user_id"], "start", "end", ["event_id"])
    return merged.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("end").alias("last"))


def w6_block_values(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    title = F.col("event_type") == "signup"
    rates = windows.within_next(rows, ["user_id"], _ORD, title, F.col("event_type") == "purchase", F.col("value"), 6, last=True).select("event_id", F.col("found").alias("rate"))
    gmi = windows.within_next(rows, ["user_id"], _ORD, title, F.col("event_type") == "view", F.col("value"), 12, last=False).select("event_id", F.col("found").alias("gmi"))
    return rates.join(gmi, "event_id")


def w8_run_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.length("l_returnflag") + F.pmod("l_partkey", F.lit(9))).alias("length"))
    return rows.select("l_orderkey", "l_linenumber", windows.running_offset(F.col("length"), ["l_orderkey"], ["l_linenumber"]).alias("offset"))


def w9_tree(spark: SparkSession, d: str) -> DataFrame:
    """Folders and files with their level and place: folders first and then by name without case."""
    paths = table(spark, d, "orders").selectExpr("concat(o_orderpriority, '/', o_orderstatus, '/', o_orderkey) AS path")
    return sets.tree(paths, "path").select("path", "level", "folder", "sort_name", "position")


def w10_page_repair(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max(F.pmod("l_partkey", F.lit(13))) - 4).alias("page"))
    return rows.select("l_orderkey", "l_linenumber", windows.repaired_pages(F.col("page"), F.lit(6), ["l_orderkey"], ["l_linenumber"]).alias("page"))


def w11_no_repeats(spark: SparkSession, d: str) -> DataFrame:
    return windows.without_repeats(_events(spark, d), "event_type", ["user_id"], _ORD).select("event_id")


def w12_auto_outline(spark: SparkSession, d: str) -> DataFrame:
    """Lines with large type make an outline; an order with fewer than three of them gets one entry per page."""
    big = (F.col("l_quantity") >= 35) & (F.col("l_linenumber") <= 24) & (F.col("l_partkey") % 10 != 0)
    return sets.auto_outline(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", big)


def w14_palette(spark: SparkSession, d: str) -> DataFrame:
    seen = windows.first_appearance_index(table(spark, d, "part").select("p_type", "p_partkey"), "p_type", "p_partkey")
    return seen.select("p_type", F.pmod("index", F.lit(8)).alias("colour"))


def w15_unique_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pdf_file").select("file_id", F.lower("name").alias("base")).distinct()
    return windows.numbered_names(rows, "base", ["file_id"]).select("file_id", F.col("base").alias("name"))


def w16_clusters(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "slide_match").where("similarity >= 0.6 and not isnan(similarity) and global_id_a is not null and global_id_b is not null").select(F.col("global_id_a").alias("src"), F.col("global_id_b").alias("dst"))
    nodes = table(spark, d, "slide_info").select(F.col("global_id").alias("node")).distinct()
    return graph.clusters(nodes, edges).select("node", "cluster")


def w17_closure(spark: SparkSession, d: str) -> DataFrame:
    """Slides reachable from those without a title, over the links of slide_match in both directions."""
    match = table(spark, d, "slide_match").where("similarity >= 0.6 and not isnan(similarity)")
    edges = match.selectExpr("global_id_a AS src", "global_id_b AS dst").unionByName(match.selectExpr("global_id_b AS src", "global_id_a AS dst"))
    seeds = table(spark, d, "slide_info").where("title is null").select(F.col("global_id").alias("node"))
    return graph.closure(seeds, edges).select("node", "level")


def w19_sorted(spark: SparkSession, d: str) -> DataFrame:
    """A report order by mapped keys: risk first, then size, then name."""
    risk = F.when(F.col("c_acctbal") < 0, 0).when(F.col("c_acctbal") < 1000, 1).otherwise(2)
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return sets.ranked_by_mapped_keys(rows, {"risk": risk, "size": -F.col("c_acctbal"), "by_name": F.col("c_name"), "key": F.col("c_custkey")}).select("c_custkey", "risk", "position")


def w20_limits(spark: SparkSession, d: str) -> DataFrame:
    """Of each priority at most ten examples; the others leave before the shuffle."""
    rows = table(spark, d, "orders")
    few = keyed.top_ranked(rows.where("o_totalprice > 400000").select("o_orderpriority", "o_orderkey").distinct(), ["o_orderpriority"], [F.asc("o_orderkey")], 10)
    examples = few.groupBy("o_orderpriority").agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")), ",").alias("examples"))
    return rows.select("o_orderpriority").distinct().join(examples, "o_orderpriority", "left").na.fill("", ["examples"])


def w21_capped(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return windows.capped(rows, ["c_nationkey"], F.col("c_acctbal") > 9900, ["c_custkey"], 5).select("c_custkey")


def w22_cascade(spark: SparkSession, d: str) -> DataFrame:
    sources = sets.first_filled_of(F.col("title"), F.substring_index("text_content", "\n", 1), F.col("source_ppt"), F.lit("untitled"))
    return table(spark, d, "slide_info").select("global_id", F.md5(sources).alias("title")).distinct()


def w23_numbering(spark: SparkSession, d: str) -> DataFrame:
    category = F.when(F.col("p_type").contains("STEEL"), "steel").when(F.col("p_type").contains("TIN"), "tin").otherwise("other")
    rows = table(spark, d, "part").select("p_partkey", "p_name", category.alias("category"))
    named = rows.withColumn("p_name", F.coalesce("p_name", F.lit("")))
    return runtime.numbered_within(named, ["category"], ["p_name", "p_partkey"], "number").select("p_partkey", "category", "number")


def w24_dividers(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("user_id", "ts", "event_id", F.col("event_type").alias("chapter"))
    return windows.with_dividers(rows, ["user_id"], _ORD, "chapter").select("user_id", "final", "kind", "original", "chapter")


def w25_suffixes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "slide_info").select("global_id", F.coalesce("title", F.lit("")).alias("name")).distinct()
    return windows.numbered_names(rows, "name", ["global_id"], "（{n}）").select("global_id", F.md5("name").alias("name"))


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[0] == "w" and n[1].isdigit()}

_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
SQL = {
    "w1_forward_fill": f"SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events",
    "w3_column_spans": "SELECT l_orderkey, l_linenumber, coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 8) AS until FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R')",
    "w4_tie_break": """WITH s AS (SELECT DISTINCT global_id, source_path, source_index, coalesce(text_content, '') AS text, shape_count, has_table FROM slide_info), m AS (SELECT *, (['first', 'max_shape_count', 'N=64', 'N=32', 'has_table', 'max_text_len'])[length(source_path) % 6 + 1] AS mode FROM s)
        SELECT source_path, mode, global_id FROM m QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY CASE mode WHEN 'max_shape_count' THEN -coalesce(shape_count, 0) WHEN 'N=64' THEN CASE WHEN contains(text, mode) THEN 0 ELSE 1 END WHEN 'N=32' THEN CASE WHEN contains(text, mode) THEN 0 ELSE 1 END
        WHEN 'has_table' THEN CASE WHEN has_table THEN 0 ELSE 1 END WHEN 'max_text_len' THEN -length(text) ELSE 0 END, source_index, global_id) = 1""",
    "w5_islands": """WITH r AS (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + 1800000000 AS e FROM events), o AS (SELECT *, CASE WHEN s > max(e) OVER w THEN 1 WHEN max(e) OVER w IS NULL THEN 1 ELSE 0 END AS x FROM r WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        i AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM o) SELECT user_id, island, count(*) AS n, min(s) AS first, max(e) AS last FROM i GROUP BY 1, 2""",
    "w6_block_values": """WITH f AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS rate,
        first_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS gmi FROM events) SELECT event_id, rate, gmi FROM f WHERE event_type = 'signup'""",
    "w8_run_offsets": "WITH r AS (SELECT l_orderkey, l_linenumber, max(length(l_returnflag) + l_partkey % 9) AS length FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, coalesce(sum(length) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM r",
    "w9_tree": """WITH p AS (SELECT o_orderpriority AS a, o_orderstatus AS b, o_orderkey AS c FROM orders), t AS (SELECT DISTINCT a AS path, 1 AS level, true AS folder, lower(a) AS sort_name, '' AS parent FROM p UNION SELECT concat(a, '/', b), 2, true, lower(b), a FROM p UNION SELECT concat(a, '/', b, '/', c), 3, false, c::VARCHAR, concat(a, '/', b) FROM p)
        SELECT path, level, folder, sort_name, row_number() OVER (ORDER BY parent, NOT folder, sort_name, path) AS position FROM t""",
    "w10_page_repair": """WITH r AS (SELECT l_orderkey, l_linenumber, max(l_partkey % 13) - 4 AS page FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, least(coalesce(last_value(CASE WHEN page >= 1 THEN page END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING), 1), 6) AS page FROM r""",
    "w11_no_repeats": f"WITH r AS (SELECT event_id, event_type, lag(event_type) OVER w AS before FROM events {_W}) SELECT event_id FROM r WHERE event_type IS DISTINCT FROM before",
    "w12_auto_outline": """WITH b AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 35 AND l_linenumber <= 24 AND l_partkey % 10 <> 0), n AS (SELECT l_orderkey, count(*) AS n FROM b GROUP BY 1),
        z AS (SELECT l_orderkey, max(l_linenumber) AS last FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n WHERE n >= 3) GROUP BY 1) SELECT l_orderkey, l_linenumber AS page, 'heading' AS kind FROM b WHERE l_orderkey IN (SELECT l_orderkey FROM n WHERE n >= 3) UNION ALL SELECT l_orderkey, unnest(range(1, last + 1))::INT, 'page' FROM z""",
    "w14_palette": "SELECT p_type, (row_number() OVER (ORDER BY min(p_partkey), p_type) - 1) % 8 AS colour FROM part GROUP BY 1",
    "w15_unique_names": "WITH r AS (SELECT file_id, base, row_number() OVER (PARTITION BY base ORDER BY file_id) AS n FROM (SELECT DISTINCT file_id, lower(name) AS base FROM pdf_file)) SELECT file_id, CASE WHEN n = 1 THEN base ELSE concat(base, '_', n - 1) END AS name FROM r",
    "w16_clusters": """WITH RECURSIVE e AS (SELECT global_id_a AS a, global_id_b AS b FROM slide_match WHERE similarity >= 0.6 AND NOT isnan(similarity) AND global_id_a IS NOT NULL AND global_id_b IS NOT NULL AND global_id_a <> global_id_b UNION SELECT global_id_b, global_id_a FROM slide_match WHERE similarity >= 0.6 AND NOT isnan(similarity) AND global_id_a IS NOT NULL AND global_id_b IS NOT NULL AND global_id_a <> global_id_b),
        r AS (SELECT DISTINCT global_id AS id, global_id AS other FROM slide_info UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a), c AS (SELECT id AS node, min(other) AS label FROM r GROUP BY 1) SELECT node, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM c""",
    "w17_closure": """WITH RECURSIVE m AS (SELECT global_id_a AS a, global_id_b AS b FROM slide_match WHERE similarity >= 0.6 AND NOT isnan(similarity) AND global_id_a IS NOT NULL AND global_id_b IS NOT NULL), e AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
        r AS (SELECT DISTINCT global_id AS node, 0 AS level FROM slide_info WHERE title IS NULL UNION SELECT e.b, r.level + 1 FROM r JOIN e ON r.node = e.a WHERE r.level < 200) SELECT node, min(level) AS level FROM r GROUP BY 1""",
    "w19_sorted": "WITH r AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 1000 THEN 1 ELSE 2 END AS risk FROM customer) SELECT c_custkey, risk, row_number() OVER (ORDER BY risk, c_acctbal DESC, c_name, c_custkey) AS position FROM r",
    "w20_limits": "SELECT o_orderpriority, coalesce(array_to_string((list(DISTINCT o_orderkey ORDER BY o_orderkey) FILTER (o_totalprice > 400000))[1:10], ','), '') AS examples FROM orders GROUP BY 1",
    "w21_capped": "SELECT c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 9900 THEN 0 ELSE 1 END, c_custkey) <= 5 OR c_acctbal > 9900",
    "w22_cascade": "SELECT DISTINCT global_id, md5(coalesce(nullif(title, ''), nullif(split_part(text_content, chr(10), 1), ''), nullif(source_ppt, ''), 'untitled')) AS title FROM slide_info",
    "w23_numbering": "WITH r AS (SELECT p_partkey, p_name, CASE WHEN contains(p_type, 'STEEL') THEN 'steel' WHEN contains(p_type, 'TIN') THEN 'tin' ELSE 'other' END AS category FROM part) SELECT p_partkey, category, row_number() OVER (PARTITION BY category ORDER BY coalesce(p_name, ''), p_partkey) AS number FROM r",
    "w24_dividers": """WITH r AS (SELECT user_id, event_type AS chapter, row_number() OVER w AS original, CASE WHEN row_number() OVER w > 1 AND lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS x, ts, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        c AS (SELECT *, original + sum(x) OVER (PARTITION BY user_id ORDER BY original ROWS UNBOUNDED PRECEDING)::BIGINT AS final FROM r) SELECT user_id, final, 'row' AS kind, original, chapter FROM c UNION ALL SELECT user_id, final - 1, 'divider', NULL, chapter FROM c WHERE x = 1""",
    "w25_suffixes": "WITH r AS (SELECT global_id, name, row_number() OVER (PARTITION BY name ORDER BY global_id) AS n FROM (SELECT DISTINCT global_id, coalesce(title, '') AS name FROM slide_info)) SELECT global_id, md5(CASE WHEN n = 1 THEN name ELSE concat(name, '（', n, '）') END) AS name FROM r",
}
