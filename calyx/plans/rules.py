"""Queries of classifiers, slots, rule tables and order-bound operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx.functions import identifiers, numbers, rules, titles
from calyx.operators import graph, keyed, sequences, sets, summaries
from calyx.runtime import small, table

_SCRIPT = [("A", [["Timeline", "Outlook"], ["Efficacy"]]), ("B", [["Safety"], ["Results", "Profile"]])]
_SLOT = {"title_any": ["Safety", "Efficacy", "Outlook"], "text_all": ["the"], "content_any": ["fever", "nausea", "headache"]}


def _slides(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "slide_info").select("global_id", "source_path", "source_index", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text_content", F.lit("")).alias("text"), "shape_count", "has_table").distinct()


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """A graded table from order lines: one document per supplier."""
    rows = table(spark, d, "lineitem").selectExpr(
        "l_suppkey AS doc", "l_orderkey * 10 + l_linenumber AS ord",
        "CASE l_partkey % 9 WHEN 0 THEN concat('术语', l_partkey % 50) WHEN 1 THEN '1级' WHEN 2 THEN '2级' WHEN 3 THEN '3级' WHEN 4 THEN '4级' WHEN 5 THEN '胃肠系统疾病' WHEN 6 THEN '首选术语' WHEN 7 THEN '' ELSE 'Total' END AS label",
        "concat(cast(l_quantity as int), ' ( ', l_linenumber, '.00)') AS share", "cast(l_linenumber as string) AS events", "l_partkey",
    )
    best = rows.groupBy("doc", "ord").agg(F.min(F.struct("label", "share", "events")).alias("r"))
    cells = F.array(F.col("r.label"), *[F.col("r.share") if i % 2 else F.col("r.events") for i in range(1, 11)])
    return best.select("doc", "ord", cells.alias("cells"))


def pr7_group_values(spark: SparkSession, d: str) -> DataFrame:
    rows = _graded(spark, d).select("doc", "ord", F.posexplode(rules.group_values(F.col("cells"))).alias("grp", "v"))
    return rows.select("doc", "ord", "grp", "v.events", "v.subjects", F.round("v.share", 6).alias("share"))


def pr9_row_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).select("doc", "ord", rules.row_kind(rules.first_filled(F.col("cells"), 1)).alias("kind"))


def w2_graded_rows(spark: SparkSession, d: str) -> DataFrame:
    return sequences.graded_rows(_graded(spark, d), "doc", "ord", "cells").select("doc", "term", "level", "ord")


def pr10_sheet_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pzfx_table").select("pzfx_id", rules.sheet_type(F.coalesce("title", F.lit(""))).alias("kind")).distinct()


def pr11_sheet_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tables whose kind is wanted, or that are asked for by name."""
    asked = spark.createDataFrame([("T001",), ("T002",)], "table_id string")
    kinds = table(spark, d, "pzfx_table").select("pzfx_id", "table_id", rules.sheet_type(F.coalesce("title", F.lit(""))).alias("kind")).distinct()
    named = kinds.join(small(asked), "table_id", "left_semi")
    return kinds.where("kind = 'GMC'").unionByName(named).select("pzfx_id").distinct()


def pr15_labels_match(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_size % 10 = 0 THEN '' ELSE p_type END AS cell", "CASE p_partkey % 3 WHEN 0 THEN 'steel  plated' WHEN 1 THEN 'STEEL' ELSE concat(p_type, ' x') END AS target")
    return rows.select("p_partkey", rules.labels_match(F.col("cell"), F.col("target")).alias("strict"), rules.labels_match(F.col("cell"), F.col("target"), True).alias("older"))


def pr16_slot_rule(spark: SparkSession, d: str) -> DataFrame:
    return _slides(spark, d).where(rules.slot_matches(F.col("title"), F.col("text"), _SLOT)).select("global_id")


def pr17_script_place(spark: SparkSession, d: str) -> DataFrame:
    rows = _slides(spark, d).withColumn("p", rules.script_place(F.col("title"), _SCRIPT)).where("p is not null")
    return rows.select("global_id", F.col("p.chapter").alias("chapter"), F.col("p.slot").alias("slot"))


def pr18_keyword_bag(spark: SparkSession, d: str) -> DataFrame:
    return _slides(spark, d).where(rules.keyword_bag(F.col("title"), ["Outlook", "Comparison"])).select("global_id")


def pr19_slide_score(spark: SparkSession, d: str) -> DataFrame:
    return _slides(spark, d).select("global_id", rules.slide_score(F.col("shape_count"), F.col("has_table"), F.col("text"), ["95% CI"], ["booster"]).alias("score"))


def pr20_chapter(spark: SparkSession, d: str) -> DataFrame:
    return _slides(spark, d).select("global_id", rules.chapter(F.concat_ws(" ", "title", "text"), ("4", ["booster"]), [("1", ["timeline"]), ("2", ["efficacy", "抗体"]), ("3", ["safety"])]).alias("chapter"))


def pr39_default_class(spark: SparkSession, d: str) -> DataFrame:
    return _slides(spark, d).select("global_id", rules.chapter(F.concat_ws(" ", "title", "text"), ("4", ["booster"]), [("1", ["timeline"])], "3").alias("chapter"))


def pr23_stale_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE o_orderkey END AS size", "concat('f', o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '.TMP' WHEN 1 THEN '.log' ELSE '.docx' END) AS name", "o_orderdate AS modified")
    rows = files.withColumn("reasons", rules.stale_reasons(F.col("size"), F.col("name"), ["tmp", "log"]))
    return rows.where((F.size("reasons") > 0) & rules.is_stale(F.col("modified"), F.expr("timestamp_ntz'1997-01-01 00:00:00'"), 90)).select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))


def pr24_folder_risk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("concat(CASE o_orderkey % 5 WHEN 0 THEN 'C:/Windows/' WHEN 1 THEN 'C:/Users/x/Cache/' ELSE 'C:/Users/y/' END, o_custkey % 50) AS path", "cast(o_totalprice as bigint) AS size").groupBy("path").agg(F.sum("size").alias("size"))
    return rows.select("path", rules.folder_risk(F.col("path"), F.col("size"), ["/windows/"], ["/cache/"], 60_000_000).alias("risk")).where("risk is not null")


def pr32_lan_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").selectExpr("c_custkey", "concat(CASE c_custkey % 3 WHEN 0 THEN '192.168.1.' WHEN 1 THEN '192.168.2.' ELSE '8.8.8.' END, c_custkey % 250) AS ip", "CASE c_custkey % 4 WHEN 0 THEN 'ff-ff-ff-ff-ff-ff' WHEN 1 THEN '01:00:5e:00:00:01' ELSE '3c:22:fb:00:00:10' END AS mac")
    inside = F.floor(identifiers.ip_number(F.col("ip")) / 256) == F.floor(identifiers.ip_number(F.lit("192.168.1.77")) / 256)
    return rows.where(identifiers.is_private_ip(F.col("ip")) & identifiers.is_unicast_mac(F.col("mac")) & inside).select("c_custkey")


def pr36_excluded_text(spark: SparkSession, d: str) -> DataFrame:
    """Objects that are no text stay; text stays unless it is too far right, where the excluded strip lies."""
    rows = sets.without_strip(table(spark, d, "lineitem"), F.col("l_returnflag") == "N", F.col("l_quantity"), 5, 40)
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("kept"))


def pr37_report_subsets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pdf_file").select("file_id", "error").distinct()
    return sets.subsets(rows, {"failed": F.col("error").isNotNull(), "fine": F.col("error").isNull()}).select("file_id", "report")


def pr38_column_order(spark: SparkSession, d: str) -> DataFrame:
    return sets.reordered(table(spark, d, "nation"), ["n_name", "missing", "n_nationkey"])


def pr40_covering_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Pictures that cover most of a page without any other element that holds text."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    holds = (F.col("l_returnflag") == "R") & (F.col("l_partkey") % 4 != 0)
    found = sets.covering_pictures(rows.where("l_returnflag = 'N'"), rows, ["l_orderkey"], F.col("l_quantity") / 50, holds)
    return found.select("l_orderkey", "l_linenumber", "l_partkey")


def j17_slot_choice(spark: SparkSession, d: str) -> DataFrame:
    """Of the slides that fit a script's slot, the one with most shapes; the first wins ties."""
    rows = _slides(spark, d).withColumn("p", rules.script_place(F.col("title"), _SCRIPT)).where("p is not null").select("p.chapter", "p.slot", "global_id", F.coalesce("shape_count", F.lit(0)).alias("shapes"))
    return keyed.best_row(rows, ["chapter", "slot"], [F.col("shapes"), -F.col("global_id")], ["global_id", "shapes"])


def e1_rule_engine(spark: SparkSession, d: str) -> DataFrame:
    """Rules as a table: each takes the first document that holds its keyword, else its page is reported."""
    ruleset = [(1, "booster", "A1"), (2, "nausea", "B2"), (3, "no such word", "C3")]
    cells = spark.createDataFrame(ruleset, "ord int, keyword string, cell string")
    return summaries.rule_engine(table(spark, d, "documents"), "doc_id", "text", cells, [r[:2] for r in ruleset]).select("ord", "cell", "doc_id", "status")


def e5_selected_first(spark: SparkSession, d: str) -> DataFrame:
    """Of the candidates of a table the one that was selected by hand, else the first."""
    return summaries.selected_first(table(spark, d, "lineitem"), "l_partkey", F.col("l_quantity") == 17, ["l_orderkey", "l_linenumber", "l_suppkey"], ["l_orderkey", "l_linenumber"])


def e6_custom_map(spark: SparkSession, d: str) -> DataFrame:
    names = identifiers.mapped(F.col("r_name"), {"ASIA": "east", "EUROPE": "west"})
    return table(spark, d, "region").select("r_regionkey", F.coalesce(names, F.lower("r_name")).alias("name"))


def s3_table_near_keyword(spark: SparkSession, d: str) -> DataFrame:
    """Per order the first line that holds the flag, else the first line of a matching one."""
    return summaries.table_near_keyword(table(spark, d, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", ["l_linenumber", "l_partkey"], ["l_linenumber", "l_partkey"])


def w13_kept_greedily(spark: SparkSession, d: str) -> DataFrame:
    """Greedy removal, component by component, over the recorded pairs of slides."""
    rows = table(spark, d, "slide_match").where("global_id_a <> global_id_b and similarity >= 0.85 and not isnan(similarity)").select(F.least("global_id_a", "global_id_b").alias("a"), F.greatest("global_id_a", "global_id_b").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    slides = table(spark, d, "slide_info").groupBy(F.col("global_id").alias("id")).agg(F.coalesce(F.max("shape_count"), F.lit(0)).alias("score"))
    parts = graph.clusters(slides.select(F.col("id").alias("node")), rows.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("id"), F.col("label").alias("component"))
    items = slides.join(parts, "id").select("component", "id", F.col("id").alias("ord"), "score")
    pairs = rows.join(parts.select(F.col("id").alias("a"), "component"), "a").select("component", "a", "b", "similarity")
    return sequences.kept_greedily(items, pairs, "component", 0.85)


def w18_merged_boxes(spark: SparkSession, d: str) -> DataFrame:
    boxes = table(spark, d, "lineitem").selectExpr("l_suppkey AS doc", "cast(l_linenumber as bigint) AS page", "l_quantity * 12 AS x0", "cast(l_partkey % 700 as double) AS top", "l_quantity * 12 + 20 AS x1", "cast(l_partkey % 700 + 9 as double) AS bottom")
    return sequences.merged_boxes(boxes, ["doc", "page"])


def j15_aligned_columns(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity").repartition("l_orderkey")  # moved once, for both
    grid = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"), F.max("l_quantity").alias("q"))
    cells = grid.select("l_orderkey", (F.col("l_linenumber") - 1).alias("row"), F.posexplode(F.array(F.col("status"), F.col("flag"), F.col("q").cast("string"))).alias("col", "value"))
    out = sequences.aligned_columns(cells, "l_orderkey", ["N", "R"], ["17.0"])
    return out.select("l_orderkey", "cat_col", "val_col", F.array_join("rows", ",").alias("rows"))


def f16_hierarchy_title(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "slide_info").select("global_id", F.posexplode(F.split(F.coalesce("text_content", F.lit("")), "\n")).alias("at", "line")).distinct()
    sized = lines.where(F.trim("line") != "").withColumn("size", F.when(F.col("at") == 0, 20.04).otherwise(12.0))
    found = sequences.hierarchy_title(sized, "global_id", "at", "line", "size")
    return found.select("global_id", F.md5("title").alias("title"))


def f17_plain_title(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "slide_info").select("global_id", F.posexplode(F.split(F.coalesce("text_content", F.lit("")), "\n")).alias("at", "line")).distinct()
    found = sequences.plain_title(lines, "global_id", "at", "line")
    return found.select("global_id", F.md5("title").alias("title"))


def f32_glossary(spark: SparkSession, d: str) -> DataFrame:
    """Texts by glossary, else by cache, else through a translator: only distinct misses reach it."""
    from calyx.operators.translation import translated, upper_client

    texts = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("text"))
    glossary = table(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_type").alias("src"), F.concat(F.lit("g:"), "p_type").alias("dst")).distinct()
    cache = table(spark, d, "part").where("p_partkey % 40 = 1").select(F.col("p_type").alias("key"), F.concat(F.lit("c:"), "p_type").alias("value")).distinct()
    return translated(texts, "text", glossary, cache, upper_client, [("STEEL", "钢")]).select("p_partkey", "translation", "origin")


def f42_normalised_labels(spark: SparkSession, d: str) -> DataFrame:
    band = F.regexp_replace(F.regexp_replace(F.trim("age_band"), "[~～–—至]", "-"), r"\s+", "")
    rows = table(spark, d, "pzfx_table").select("pzfx_id", band.alias("age"), F.coalesce(identifiers.mapped(F.trim("metric"), {"SCR": "阳转率", "阳转": "阳转率", "LS GMC": "GMC"}), F.trim("metric")).alias("metric"))
    return rows.distinct()


def pr13b_scaled_if_close(spark: SparkSession, d: str) -> DataFrame:
    v, t = F.col("l_quantity"), F.col("l_discount") * 10
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(numbers.close(v / 100, t, 0.05), v / 100).otherwise(v).alias("value"))


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[:1] in "pjesfw" and any(c.isdigit() for c in n[:3])}

_SL = "SELECT DISTINCT global_id, source_path, coalesce(title, '') AS title, coalesce(text_content, '') AS text, shape_count, has_table FROM slide_info"
_GR = """WITH r AS (SELECT l_suppkey AS doc, l_orderkey * 10 + l_linenumber AS ord, CASE l_partkey % 9 WHEN 0 THEN concat('术语', l_partkey % 50) WHEN 1 THEN '1级' WHEN 2 THEN '2级' WHEN 3 THEN '3级' WHEN 4 THEN '4级' WHEN 5 THEN '胃肠系统疾病' WHEN 6 THEN '首选术语' WHEN 7 THEN '' ELSE 'Total' END AS label,
    concat(l_quantity::INT, ' ( ', l_linenumber, '.00)') AS share, l_quantity::INT AS q, l_linenumber AS e FROM lineitem), g AS (SELECT doc, ord, min((label, share, e, q)) AS r FROM r GROUP BY 1, 2)"""
_PLACE = "CASE WHEN contains(title, 'Timeline') OR contains(title, 'Outlook') THEN 0 WHEN contains(title, 'Efficacy') THEN 1 WHEN contains(title, 'Safety') THEN 2 WHEN contains(title, 'Results') OR contains(title, 'Profile') THEN 3 END"
_CH = "lower(concat(title, ' ', text))"
_HINT = f"WHEN regexp_matches({_CH}, '[0-9]') AND (contains({_CH}, '安全') OR contains({_CH}, 'safety') OR contains({_CH}, '不良') OR contains({_CH}, 'adverse')) THEN '3' WHEN regexp_matches({_CH}, '[0-9]') AND (contains({_CH}, '%') OR contains({_CH}, 'percent') OR contains({_CH}, '百分比') OR contains({_CH}, '总体') OR contains({_CH}, 'overview')) THEN '2'"

SQL = {
    "pr7_group_values": f"{_GR} SELECT doc, ord, unnest([0, 1, 2, 3, 4]) AS grp, r[3]::INT AS events, r[4]::INT AS subjects, round(r[3] / 100, 6) AS share FROM g",
    "pr9_row_kinds": f"{_GR} SELECT doc, ord, CASE WHEN r[1] = '' OR r[1] = '首选术语' THEN 'header' WHEN r[1] IN ('1级', '2级', '3级', '4级') THEN 'grade' WHEN r[1] = 'Total' THEN 'total' WHEN r[1] = '胃肠系统疾病' THEN 'class' ELSE 'term' END AS kind FROM g",
    "pr10_sheet_type": "SELECT DISTINCT pzfx_id, CASE WHEN contains(upper(coalesce(title, '')), 'GMI') THEN 'GMI' WHEN contains(upper(coalesce(title, '')), 'GMC') OR contains(upper(coalesce(title, '')), 'GMT') THEN 'GMC' WHEN contains(title, '阳转') OR contains(upper(title), 'RATE') THEN 'rate' ELSE 'other' END AS kind FROM pzfx_table",
    "pr11_sheet_tasks": "SELECT DISTINCT pzfx_id FROM pzfx_table WHERE table_id IN ('T001', 'T002') OR (NOT contains(upper(coalesce(title, '')), 'GMI') AND (contains(upper(title), 'GMC') OR contains(upper(title), 'GMT')))",
    "pr15_labels_match": """WITH s AS (SELECT p_partkey, lower(CASE WHEN p_size % 10 = 0 THEN '' ELSE p_type END) AS c, CASE p_partkey % 3 WHEN 0 THEN 'steel plated' WHEN 1 THEN 'steel' ELSE concat(lower(p_type), ' x') END AS t, p_partkey % 3 AS k, lower(p_type) AS p FROM part)
        SELECT p_partkey, c <> '' AND (contains(c, t) OR contains(t, c) OR (k = 0 AND contains(c, 'steel') AND contains(c, 'plated')) OR (k = 2 AND contains(c, 'x') AND contains(c, p))) AS strict, contains(c, t) OR contains(t, c) OR (k = 0 AND contains(c, 'steel') AND contains(c, 'plated')) AS older FROM s""",
    "pr16_slot_rule": f"WITH s AS ({_SL}) SELECT global_id FROM s WHERE (contains(title, 'Safety') OR contains(title, 'Efficacy') OR contains(title, 'Outlook')) AND contains(concat(title, chr(10), text), 'the') AND (contains(concat(title, chr(10), text), 'fever') OR contains(concat(title, chr(10), text), 'nausea') OR contains(concat(title, chr(10), text), 'headache'))",
    "pr18_keyword_bag": f"""WITH s AS ({_SL}), t AS (SELECT global_id, lower(title) AS t FROM s) SELECT global_id FROM t WHERE trim(t, ' ') <> '' AND (contains(t, 'outlook') OR contains(t, 'comparison')
        OR len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '' AND (contains(w, 'out') OR contains('out', w) OR contains(w, 'com') OR contains('com', w)))) > 0)""",
    "pr19_slide_score": f"WITH s AS ({_SL}) SELECT global_id, coalesce(shape_count, 0) * 10 + CASE WHEN has_table THEN 100 ELSE 0 END + CASE WHEN contains(lower(text), '95% ci') THEN 50 ELSE 0 END + CASE WHEN contains(lower(text), 'booster') THEN 200 ELSE 0 END AS score FROM s",
    "pr20_chapter": f"WITH s AS ({_SL}) SELECT global_id, CASE WHEN trim({_CH}, ' ') = '' THEN NULL WHEN contains({_CH}, 'booster') THEN '4' WHEN contains({_CH}, 'timeline') THEN '1' WHEN contains({_CH}, 'efficacy') OR contains({_CH}, '抗体') THEN '2' WHEN contains({_CH}, 'safety') THEN '3' {_HINT} END AS chapter FROM s",
    "pr39_default_class": f"WITH s AS ({_SL}) SELECT global_id, CASE WHEN trim({_CH}, ' ') = '' THEN '3' WHEN contains({_CH}, 'booster') THEN '4' WHEN contains({_CH}, 'timeline') THEN '1' {_HINT} ELSE '3' END AS chapter FROM s",
    "pr23_stale_files": """WITH f AS (SELECT o_orderkey, o_custkey % 7 = 0 AS empty, o_orderkey % 4 < 2 AS ext FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' - INTERVAL 90 DAY) SELECT o_orderkey, concat_ws(',', CASE WHEN empty THEN 'empty' END, CASE WHEN ext THEN 'extension' END) AS reasons FROM f WHERE empty OR ext""",
    "pr24_folder_risk": """WITH f AS (SELECT concat(CASE o_orderkey % 5 WHEN 0 THEN 'C:/Windows/' WHEN 1 THEN 'C:/Users/x/Cache/' ELSE 'C:/Users/y/' END, o_custkey % 50) AS path, sum(floor(o_totalprice)) AS size FROM orders GROUP BY 1), r AS (SELECT path, CASE WHEN contains(path, '/Windows/') THEN 'dangerous' WHEN contains(path, '/Cache/') THEN 'safe' WHEN size >= 60000000 THEN 'review' END AS risk FROM f) SELECT * FROM r WHERE risk IS NOT NULL""",
    "pr32_lan_scope": "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 >= 2",
    "pr36_excluded_text": "SELECT l_orderkey, count(*) AS kept FROM lineitem WHERE l_returnflag <> 'N' OR l_quantity + 5 < 40 GROUP BY 1",
    "pr37_report_subsets": "SELECT DISTINCT file_id, CASE WHEN error IS NULL THEN 'fine' ELSE 'failed' END AS report FROM pdf_file",
    "pr38_column_order": "SELECT n_name, n_nationkey, n_regionkey FROM nation",
    "pr40_covering_pictures": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity / 50 >= 0.9 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 4 <> 0)",
    "j17_slot_choice": f"WITH s AS ({_SL}), p AS (SELECT *, {_PLACE} AS k, coalesce(shape_count, 0) AS shapes FROM s WHERE trim(title) <> '') SELECT CASE WHEN k < 2 THEN 'A' ELSE 'B' END AS chapter, k % 2 AS slot, global_id, shapes FROM p WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY shapes DESC, global_id) = 1",
    "pr17_script_place": f"WITH s AS ({_SL}), p AS (SELECT *, {_PLACE} AS k FROM s WHERE trim(title) <> '') SELECT global_id, CASE WHEN k < 2 THEN 'A' ELSE 'B' END AS chapter, k % 2 AS slot FROM p WHERE k IS NOT NULL",
    "e1_rule_engine": "WITH r(ord, keyword, cell) AS (VALUES (1, 'booster', 'A1'), (2, 'nausea', 'B2'), (3, 'no such word', 'C3')) SELECT ord, cell, min(doc_id) AS doc_id, CASE WHEN min(doc_id) IS NULL THEN 'not found' ELSE 'ok' END AS status FROM r LEFT JOIN documents ON contains(text, keyword) GROUP BY 1, 2",
    "e5_selected_first": "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity <> 17, l_orderkey, l_linenumber, l_suppkey) = 1",
    "e6_custom_map": "SELECT r_regionkey, CASE r_name WHEN 'ASIA' THEN 'east' WHEN 'EUROPE' THEN 'west' ELSE lower(r_name) END AS name FROM region",
    "s3_table_near_keyword": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', l_linenumber, l_partkey) = 1",
    "f32_glossary": """WITH g AS (SELECT DISTINCT p_type FROM part WHERE p_partkey % 50 = 0), c AS (SELECT DISTINCT p_type FROM part WHERE p_partkey % 40 = 1)
        SELECT p_partkey, CASE WHEN p_type IN (SELECT p_type FROM g) THEN concat('g:', p_type) WHEN p_type IN (SELECT p_type FROM c) THEN concat('c:', p_type) ELSE replace(upper(p_type), 'STEEL', '钢') END AS translation,
        CASE WHEN p_type IN (SELECT p_type FROM g) THEN 'glossary' WHEN p_type IN (SELECT p_type FROM c) THEN 'cache' ELSE 'client' END AS origin FROM part""",
    "f42_normalised_labels": r"SELECT DISTINCT pzfx_id, regexp_replace(regexp_replace(trim(age_band), '[~～–—至]', '-', 'g'), '\s+', '', 'g') AS age, CASE trim(metric) WHEN 'SCR' THEN '阳转率' WHEN '阳转' THEN '阳转率' WHEN 'LS GMC' THEN 'GMC' ELSE trim(metric) END AS metric FROM pzfx_table",
    "pr13b_scaled_if_close": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(l_quantity / 100 - l_discount * 10) <= 0.05 THEN l_quantity / 100 ELSE l_quantity END AS value FROM lineitem",
}
