"""Queries of the aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx.functions import numbers as num
from calyx.operators import keyed, sets, summaries
from calyx.runtime import small, table

#: Fixed values of the example: words and weights of a scan.
WEIGHTS = {"dose": 1, "margin": 2, "booster": 3, "of": 1}
LEVELS = ("LOW", "MEDIUM", "HIGH", "UNKNOWN")


def a1_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pdf_file").select("file_id", F.lower("name").alias("file_name"))
    return summaries.duplicate_groups(rows, "file_name", "file_id")


def a2_merged_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "serology_row")
    return keyed.merged_fields(rows, ["sample", "marker"], ["value", "note"], ["file_ord", "row_ord", "serology_id"])


def a3_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    return keyed.best_row(rows, ["o_custkey"], [F.col("o_orderdate"), -F.col("o_orderkey")], ["o_orderkey", "o_orderdate", "o_totalprice"])


def a4_best_by_score(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "slide_info").where(F.col("shape_count").isNotNull())
    return keyed.best_row(rows, ["source_path"], [F.col("shape_count"), -F.col("global_id")], ["global_id", "shape_count"])


def a5_coverage(spark: SparkSession, d: str) -> DataFrame:
    return summaries.complete_per_group(table(spark, d, "pzfx_table"), "age_band", "pzfx_id", ["n_columns"])


def a6_extraction_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "serology_row").groupBy("marker").agg(F.count(F.lit(1)).alias("expected"), F.count_if(keyed.filled(F.col("value")).isNotNull()).alias("extracted"))
    return rows.withColumn("enough", F.col("extracted") / F.col("expected") >= 0.6)


def a7_keyword_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", keyed.keyword_score(F.lower(F.col("text")), WEIGHTS).alias("score"))


def _risk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    text = F.lower(F.col("text"))
    numbers = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))))
    score = F.when(F.col("lang") == "de", 1).otherwise(keyed.keyword_score(text, {"query": 1, "audit": 1}) + 2 * F.regexp_count(text, F.lit("deviation")) + F.least(numbers, F.lit(5)))
    score = F.when(F.col("text").isNotNull(), score)
    return docs.select("doc_id", score.cast("int").alias("score"), keyed.risk_level(score, F.col("text").isNotNull()).alias("level"))


def a8_risk_score(spark: SparkSession, d: str) -> DataFrame:
    return _risk(spark, d)


def a9_level_histogram(spark: SparkSession, d: str) -> DataFrame:
    levels = spark.createDataFrame([(x,) for x in LEVELS], "level string")
    return keyed.counts_with_zeros(_risk(spark, d), "level", levels, "level")


def a10_batch_status(spark: SparkSession, d: str) -> DataFrame:
    return summaries.status_totals(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", {"done": "F", "open": "O", "partial": "P"}, "o_totalprice")


def a11_top_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_seen"))
    return keyed.top_overall(rows, [F.desc("n"), F.asc("first_seen")], 15).select("user_id", "n")


def a12_best_and_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = summaries.best_and_mean(table(spark, d, "events").where("event_type <> 'error'"), "event_type", "event_id", "value")
    return rows.select("event_type", "best_id", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"), "verdict")


def a13_ping_summary(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "events").selectExpr("user_id", "CASE event_id % 4 WHEN 0 THEN 'Request timed out.' WHEN 1 THEN concat('time<', event_id % 9 + 1, 'ms TTL=64') ELSE concat('bytes=32 time=', event_id % 90, 'ms') END AS line")
    ms = num.number(num.part(F.col("line"), r"time[=<](\d+)", 1))
    return lines.groupBy("user_id").agg(F.round(F.avg(ms), 6).alias("mean_ms"), F.round(100.0 * F.count_if(ms.isNull()) / F.count(F.lit(1)), 4).alias("loss_percent"))


def a14_files_per_folder(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pdf_file").where("error is null").select("file_id", "folder").distinct()
    folders = table(spark, d, "pdf_file").select("folder").distinct()
    return keyed.counts_with_zeros(files, "folder", folders, "folder", "files")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("concat(o_orderpriority, '/', o_orderstatus, '/', o_custkey % 20, '/', o_orderkey) AS path", "cast(o_totalprice as bigint) AS size", "o_orderdate AS changed")


def a15_folder_size(spark: SparkSession, d: str) -> DataFrame:
    return keyed.prefix_totals(_paths(spark, d), "path", "size", "changed")


def a16_frequent_words(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").where("text is not null").select("doc_type", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word"))
    return keyed.frequent_items(words.where(~F.col("word").isin("the", "and", "of")), "word", "doc_type", 4)


def a17_routing(spark: SparkSession, d: str) -> DataFrame:
    """Routed by the number of first three lines of an order that hold a returned item."""
    return summaries.routed_by_hits(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R", 3)


def a18_anomaly_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals over pages, and which pages are bad; pages of one order are few."""
    return summaries.anomaly_totals(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_tax") > 0.06)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "slide_match").where("global_id_a is not null and global_id_b is not null and global_id_a <> global_id_b and similarity is not null and not isnan(similarity)")
    return rows.groupBy(F.least("global_id_a", "global_id_b").alias("a"), F.greatest("global_id_a", "global_id_b").alias("b")).agg(F.max("similarity").alias("similarity"))


def a19_max_similarity(spark: SparkSession, d: str) -> DataFrame:
    return summaries.best_match_per_key(table(spark, d, "slide_info"), "global_id", _pairs(spark, d))


def a20_decisions(spark: SparkSession, d: str) -> DataFrame:
    size = table(spark, d, "slide_info").groupBy(F.col("global_id").alias("id")).agg(F.coalesce(F.max("shape_count"), F.lit(0)).alias("shapes"))
    return keyed.decisions(_pairs(spark, d), size, 0.6, 0.9)


def a21_distinct_series(spark: SparkSession, d: str) -> DataFrame:
    return summaries.distinct_series(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], F.col("l_partkey") != F.col("l_suppkey"))


def a22_distinct_reasons(spark: SparkSession, d: str) -> DataFrame:
    return summaries.reasons_per_group(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", ["l_orderkey", "l_partkey"])


def a23_rule_hits(spark: SparkSession, d: str) -> DataFrame:
    rules = {"high discount": F.col("l_discount") > 0.08, "no tax": F.col("l_tax") == 0, "bulk": F.col("l_quantity") > 45}
    return summaries.rule_hits(table(spark, d, "lineitem"), rules)


def a25_top_in_class(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return keyed.top_ranked(rows, ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("c_mktsegment", "c_custkey", "rank")


def a26_class_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "small").when(F.col("c_acctbal") < 9000, "big").otherwise("unclassified").alias("class"))
    classes = spark.createDataFrame([(x,) for x in ("debt", "small", "big", "huge", "unclassified")], "class string")
    return keyed.counts_with_zeros(rows, "class", classes, "class")


def a27_part_statistics(spark: SparkSession, d: str) -> DataFrame:
    return summaries.part_statistics(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", F.col("l_discount") > 0)


def a28_reduction(spark: SparkSession, d: str) -> DataFrame:
    return summaries.reduction(table(spark, d, "slide_info"), "source_path", "global_id")


def a29_readable_files(spark: SparkSession, d: str) -> DataFrame:
    return summaries.readable_files(table(spark, d, "pdf_file"), "folder", "error", "page1_text")


def a30_channel_median(spark: SparkSession, d: str) -> DataFrame:
    """The median of a fixed-size sample block per channel; here of prices by brand."""
    return summaries.channel_median(table(spark, d, "part"), "p_brand", "p_retailprice")


def u1_union_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "customer").select(F.col("c_nationkey").alias("id")), table(spark, d, "supplier").select("s_nationkey"), spark.createDataFrame([(99,)], "id int")
    return sets.union_of(ids)


def u2_common_ids(spark: SparkSession, d: str) -> DataFrame:
    return sets.compared(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), table(spark, d, "events").select(F.col("user_id").alias("id")))


def u3_undeclared(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").withColumn("part", F.col("p_partkey"))
    return sets.undeclared(table(spark, d, "lineitem").select(F.col("l_partkey").alias("part")), "part", parts.where("p_size > 10"), parts.where("p_brand = 'Brand#11'"))


def u4_used_custom(spark: SparkSession, d: str) -> DataFrame:
    custom = table(spark, d, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"))
    return sets.usage(custom, table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("id")))


def u5_concatenated(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return sets.concatenated({"customer": customers, "supplier": suppliers})


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[0] in "au" and name[1].isdigit()}

_TXT = "lower(text)"
_HIT = " + ".join(f"len(regexp_extract_all({_TXT}, '{w}[^a-zA-Z0-9]')) * {n}" for w, n in WEIGHTS.items())
_RISK = f"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN lang = 'de' THEN 1 ELSE len(regexp_extract_all({_TXT}, 'query[^a-zA-Z0-9]')) + len(regexp_extract_all({_TXT}, 'audit[^a-zA-Z0-9]'))
    + 2 * len(regexp_extract_all({_TXT}, 'deviation')) + least(len(list_distinct(regexp_extract_all({_TXT}, '[0-9]+'))), 5) END AS score FROM documents"""
_LEVEL = "CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN score = 0 THEN 'LOW' WHEN score <= 4 THEN 'MEDIUM' ELSE 'HIGH' END"
_PAIR = """SELECT least(global_id_a, global_id_b) AS a, greatest(global_id_a, global_id_b) AS b, max(similarity) AS similarity FROM slide_match
    WHERE global_id_a <> global_id_b AND similarity IS NOT NULL AND NOT isnan(similarity) GROUP BY 1, 2"""

SQL = {
    "a1_duplicate_groups": "SELECT lower(name) AS file_name, count(DISTINCT file_id) AS files, min(file_id) AS first_id FROM pdf_file GROUP BY 1 HAVING count(DISTINCT file_id) > 1",
    "a2_merged_fields": """SELECT sample, marker, arg_max(nullif(trim(value), ''), (file_ord, row_ord, serology_id)) FILTER (nullif(trim(value), '') IS NOT NULL) AS value,
        arg_max(nullif(trim(note), ''), (file_ord, row_ord, serology_id)) FILTER (nullif(trim(note), '') IS NOT NULL) AS note, min(file_ord) AS first_seen FROM serology_row GROUP BY 1, 2""",
    "a3_latest_per_key": "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
    "a4_best_by_score": "SELECT source_path, global_id, shape_count FROM (SELECT DISTINCT source_path, global_id, shape_count FROM slide_info WHERE shape_count IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY shape_count DESC, global_id) = 1",
    "a5_coverage": "SELECT age_band, count(DISTINCT pzfx_id) AS complete FROM pzfx_table WHERE age_band IS NOT NULL AND n_columns IS NOT NULL GROUP BY 1",
    "a6_extraction_coverage": "SELECT marker, count(*) AS expected, count(nullif(trim(value), '')) AS extracted, count(nullif(trim(value), '')) / count(*) >= 0.6 AS enough FROM serology_row GROUP BY 1",
    "a7_keyword_score": f"SELECT doc_id, {_HIT} AS score FROM documents",
    "a8_risk_score": f"WITH r AS ({_RISK}) SELECT doc_id, score, {_LEVEL} AS level FROM r",
    "a9_level_histogram": f"WITH r AS ({_RISK}), c AS (SELECT {_LEVEL} AS level, count(*) AS n FROM r GROUP BY 1) SELECT l.level, coalesce(n, 0) AS n FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('UNKNOWN')) l(level) LEFT JOIN c USING (level)",
    "a10_batch_status": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS partial, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "a11_top_counts": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 15",
    "a12_best_and_mean": """WITH s AS (SELECT * FROM events WHERE value IS NOT NULL AND event_type <> 'error'), g AS (SELECT event_type, max(value) AS best, avg(value) AS mean, arg_max(event_id, (value, -event_id)) AS best_id FROM s GROUP BY 1)
        SELECT event_type, best_id, round(best, 6) AS best, round(mean, 6) AS mean, CASE WHEN mean / best >= 0.85 THEN 'even' WHEN mean / best >= 0.4 THEN 'mixed' ELSE 'uneven' END AS verdict FROM g""",
    "a13_ping_summary": "SELECT user_id, round(avg(CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN event_id % 9 + 1 ELSE event_id % 90 END), 6) AS mean_ms, round(100.0::DOUBLE * count(*) FILTER (event_id % 4 = 0) / count(*), 4) AS loss_percent FROM events GROUP BY 1",
    "a14_files_per_folder": "SELECT f.folder, count(p.file_id) AS files FROM (SELECT DISTINCT folder FROM pdf_file) f LEFT JOIN (SELECT DISTINCT folder, file_id FROM pdf_file WHERE error IS NULL) p ON f.folder = p.folder GROUP BY 1",
    "a15_folder_size": """WITH p AS (SELECT o_orderpriority AS a, o_orderstatus AS b, o_custkey % 20 AS c, cast(round_even(o_totalprice, 10) - (o_totalprice - floor(o_totalprice)) AS BIGINT) AS size, o_orderdate AS changed FROM orders),
        f AS (SELECT a AS folder, size, changed FROM p UNION ALL SELECT concat(a, '/', b), size, changed FROM p UNION ALL SELECT concat(a, '/', b, '/', c), size, changed FROM p)
        SELECT folder, sum(size)::BIGINT AS total_size, count(*) AS files, max(changed) AS latest FROM f GROUP BY 1""",
    "a16_frequent_words": "WITH w AS (SELECT doc_type, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM documents) SELECT word, count(DISTINCT coalesce(doc_type, '?')) AS places FROM w WHERE word NOT IN ('the', 'and', 'of') GROUP BY 1 HAVING places >= 4",
    "a17_routing": "SELECT l_orderkey, CASE WHEN count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_linenumber END) >= 1 THEN 'vector' ELSE 'scan' END AS route FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1",
    "a18_anomaly_totals": "SELECT l_orderkey, count(*) AS pages, count(*) FILTER (l_tax > 0.06) AS distorted, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (l_tax > 0.06), '') AS bad_pages FROM lineitem GROUP BY 1",
    "a19_max_similarity": f"WITH p AS ({_PAIR}), e AS (SELECT a AS id, similarity FROM p UNION ALL SELECT b, similarity FROM p) SELECT s.global_id, coalesce(max(similarity), 0) AS max_similarity FROM (SELECT DISTINCT global_id FROM slide_info) s LEFT JOIN e ON s.global_id = e.id GROUP BY 1",
    "a20_decisions": f"""WITH p AS ({_PAIR}), z AS (SELECT global_id AS id, coalesce(max(shape_count), 0) AS shapes FROM slide_info GROUP BY 1),
        l AS (SELECT CASE WHEN x.shapes < y.shapes THEN a ELSE b END AS id FROM p JOIN z x ON p.a = x.id JOIN z y ON p.b = y.id WHERE similarity >= 0.9), n AS (SELECT a AS id FROM p WHERE similarity >= 0.6 UNION SELECT b FROM p WHERE similarity >= 0.6)
        SELECT id, CASE WHEN id IN (SELECT id FROM l) THEN 'drop_conflict' WHEN id IN (SELECT id FROM n) THEN 'keep_partial_overlap' ELSE 'keep_unique' END AS decision FROM z""",
    "a21_distinct_series": "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey <> l_suppkey",
    "a22_distinct_reasons": "SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS reasons, count(DISTINCT (l_orderkey, l_partkey)) AS unique_files FROM lineitem GROUP BY 1",
    "a23_rule_hits": "WITH h AS (SELECT 'high discount' AS message FROM lineitem WHERE l_discount > 0.08 UNION ALL SELECT 'no tax' FROM lineitem WHERE l_tax = 0 UNION ALL SELECT 'bulk' FROM lineitem WHERE l_quantity > 45) SELECT message, count(*) AS hits FROM h GROUP BY 1",
    "a25_top_in_class": "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 3",
    "a26_class_counts": """WITH c AS (SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'small' WHEN c_acctbal < 9000 THEN 'big' ELSE 'unclassified' END AS class FROM customer)
        SELECT v.class, count(c.class) AS n FROM (VALUES ('debt'), ('small'), ('big'), ('huge'), ('unclassified')) v(class) LEFT JOIN c USING (class) GROUP BY 1""",
    "a27_part_statistics": "SELECT l_orderkey, sum(l_quantity) AS fills, count(*) FILTER (l_discount > 0) AS changed FROM lineitem GROUP BY 1",
    "a28_reduction": "SELECT source_path, count(*) AS before, count(DISTINCT global_id) AS after, round(100.0::DOUBLE * (count(*) - count(DISTINCT global_id)) / count(*), 4) AS reduction FROM slide_info GROUP BY 1",
    "a29_readable_files": "SELECT folder, count(*) FILTER (error IS NULL) AS added, count(*) FILTER (error IS NOT NULL) AS skipped, sum(CASE WHEN error IS NULL THEN coalesce(length(page1_text), 0) ELSE 0 END)::BIGINT AS chars FROM pdf_file GROUP BY 1",
    "a30_channel_median": "SELECT p_brand, round(median(p_retailprice), 4) AS median FROM part GROUP BY 1",
    "u1_union_ids": "SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT 99",
    "u2_common_ids": """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), b AS (SELECT DISTINCT user_id AS id FROM events)
        SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'left' WHEN a.id IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b ON a.id = b.id""",
    "u3_undeclared": "SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10 OR p_brand = 'Brand#11')",
    "u4_used_custom": "SELECT p_partkey AS id, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) THEN 'used' ELSE 'unused' END AS kind FROM part WHERE p_size % 2 = 0",
    "u5_concatenated": "SELECT 'customer' AS origin, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier",
}
