"""Queries of the remaining rules: publisher links, value and note, styles, fallback chains, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx.functions import geometry, identifiers, numbers, rules, texts, titles
from calyx.operators import sets, styles
from calyx.runtime import table


def pr8_first_filled(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", "array(CASE WHEN p_partkey % 2 = 0 THEN '  ' END, CASE WHEN p_partkey % 3 = 0 THEN p_brand END, '', CASE WHEN p_partkey % 5 = 0 THEN p_name END, p_type) AS cells")
    return rows.select("p_partkey", rules.first_filled(F.col("cells")).alias("first"))


def pr28_publisher_link(spark: SparkSession, d: str) -> DataFrame:
    """The link a DOI has at its publisher, by the journal it names."""
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN concat('10.1371/journal.pone.', o_custkey) WHEN 1 THEN concat('10.1371/journal.pmed.', o_custkey) ELSE concat('10.1016/j.', o_custkey) END AS doi")
    journal = numbers.part(F.col("doi"), r"^10\.1371/journal\.(\w{4})\.", 1)
    site = identifiers.mapped(journal, {"pone": "plosone", "pmed": "plosmedicine", "pbio": "plosbiology"})
    return rows.select("o_orderkey", F.concat(F.lit("https://journals.plos.org/"), site, F.lit("/article/file?id="), F.col("doi"), F.lit("&type=printable")).alias("link"))


def f7_value_and_note(spark: SparkSession, d: str) -> DataFrame:
    """The value and the note of a marker's cells, told apart by the sub-header or by what they hold."""
    rows = table(spark, d, "serology_row").selectExpr("serology_id", "array('', value, note) AS cells", "CASE WHEN serology_id % 2 = 0 THEN array('', '结果', '说明') END AS sub")
    pair = styles.value_and_note(F.col("cells"), F.col("sub"))
    return rows.select("serology_id", pair["value"].alias("value"), pair["note"].alias("note"))


def f10_without_brackets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", "concat(p_name, ' (', p_brand, ') [ - ] x') AS t")
    return rows.select("p_partkey", identifiers.squeeze(titles.without_brackets(F.col("t"))).alias("title"))


def f11_joined_numerals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", "concat('phase ', CASE p_partkey % 3 WHEN 0 THEN 'I/IIa' WHEN 1 THEN 'II/III' ELSE 'a/b' END, ' ', p_size) AS t")
    return rows.select("p_partkey", titles.joined_numerals(F.col("t")).alias("title"))


def f22_hue_colour(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 120 % 360).alias("hue"))
    return rows.select("n_nationkey", geometry.luma_hex(F.col("hue"), 1.0, 0.5).alias("colour"), geometry.lightened(F.lit("204060"), 0.5).alias("light"))


def f31_rate_fraction(spark: SparkSession, d: str) -> DataFrame:
    rate = F.col("l_discount") * F.when(F.col("l_orderkey") % 2 == 0, 100).otherwise(1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(numbers.as_fraction(rate, F.lit(True)), 6).alias("rate"))


def f38_style_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", "p_type AS name", "CASE WHEN p_size <= 9 THEN p_size END AS outline")
    return rows.select("p_partkey", styles.style_name(F.col("name"), F.col("outline"), [("caption", ["STEEL"]), ("table", ["TIN"]), ("note", ["SMALL"])]).alias("style"))


def f39_name_token(spark: SparkSession, d: str) -> DataFrame:
    """A name fit for a document's internal names: other characters are left out; null if nothing is left."""
    rows = table(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_size % 7 = 0 THEN '#/' ELSE concat('/', p_type, '#', p_size) END AS t")
    return rows.select("p_partkey", styles.internal_name(F.col("t")).alias("token"))


def e2_rule_objects(spark: SparkSession, d: str) -> DataFrame:
    ruleset = texts.Rules([("STEEL", "IRON"), ("STEEL PLATED", "PLATE")], [("[0-9]+", "#")])
    rows = table(spark, d, "part").selectExpr("p_partkey", "concat(p_type, ' STEEL PLATED ', p_size) AS t")
    return rows.select("p_partkey", ruleset.apply(F.col("t")).alias("text"), ruleset.replaced(F.col("t")).alias("n"))


def e3_fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    """The first provider whose self-test passes answers for all; here three expressions, one of them broken."""
    providers = [("none", F.lit(None).cast("string")), ("upper", F.upper("p_type")), ("lower", F.lower("p_type"))]
    name, answer = styles.first_working(table(spark, d, "part"), providers)
    return table(spark, d, "part").select("p_partkey", F.lit(name).alias("provider"), answer.alias("answer"))


def s15_folder_tree(spark: SparkSession, d: str) -> DataFrame:
    """Folders above every file of a listing, with their depth and the files beneath."""
    files = table(spark, d, "pdf_file").select("file_id", F.concat_ws("/", F.split("folder", "_"), F.lit("f")).alias("path")).distinct()
    return sets.folder_tree(files, "path")


def s14_listing(spark: SparkSession, d: str) -> DataFrame:
    """A listing's rule on names: one of the extensions, no lock files."""
    rows = table(spark, d, "pdf_file").select("file_id", F.trim("name").alias("name")).distinct()
    return sets.listing(rows, "name", [".pdf"]).select("file_id", "sort_name")


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[:1] in "pfes" and any(c.isdigit() for c in n[:3])}
SQL = {
    "pr8_first_filled": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 5 = 0 THEN p_name ELSE '' END AS first FROM part",
    "pr28_publisher_link": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat('https://journals.plos.org/plosone/article/file?id=10.1371/journal.pone.', o_custkey, '&type=printable') WHEN 1 THEN concat('https://journals.plos.org/plosmedicine/article/file?id=10.1371/journal.pmed.', o_custkey, '&type=printable') END AS link FROM orders",
    "f7_value_and_note": """WITH s AS (SELECT serology_id, trim(coalesce(value, ''), ' ') AS v, trim(coalesce(note, ''), ' ') AS n FROM serology_row),
        k AS (SELECT *, v IN ('阴性', '阳性', '反应', '可疑', '待查') OR (length(v) <= 4 AND regexp_full_match(v, '[一-鿿]+')) AS vn, n IN ('阴性', '阳性', '反应', '可疑', '待查') OR (length(n) <= 4 AND regexp_full_match(n, '[一-鿿]+')) AS nn FROM s)
        SELECT serology_id, CASE WHEN serology_id % 2 = 0 THEN v WHEN v <> '' AND NOT vn THEN v WHEN n <> '' AND NOT nn THEN n ELSE '' END AS value, CASE WHEN serology_id % 2 = 0 THEN n WHEN v <> '' AND vn THEN v WHEN n <> '' AND nn THEN n ELSE '' END AS note FROM k""",
    "f10_without_brackets": r"SELECT p_partkey, trim(regexp_replace(concat(p_name, '  ', p_brand, '   x'), '\s+', ' ', 'g')) AS title FROM part",
    "f11_joined_numerals": "SELECT p_partkey, concat('phase ', CASE p_partkey % 3 WHEN 0 THEN 'I_IIa' WHEN 1 THEN 'II_III' ELSE 'a/b' END, ' ', p_size) AS title FROM part",
    "f22_hue_colour": "SELECT n_nationkey, CASE n_nationkey * 120 % 360 WHEN 0 THEN 'FF0000' WHEN 120 THEN '00FF00' ELSE '0000FF' END AS colour, '8F9FAF' AS light FROM nation",
    "f31_rate_fraction": "WITH r AS (SELECT *, l_discount * CASE WHEN l_orderkey % 2 = 0 THEN 100 ELSE 1 END AS v FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN v > 1 THEN v / 100 ELSE v END, 6) AS rate FROM r",
    "f38_style_names": "SELECT p_partkey, CASE WHEN p_size <= 9 THEN concat('heading ', p_size) WHEN contains(p_type, 'STEEL') THEN 'caption' WHEN contains(p_type, 'TIN') THEN 'table' WHEN contains(p_type, 'SMALL') THEN 'note' ELSE 'body' END AS style FROM part",
    "f39_name_token": "SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN concat(replace(p_type, ' ', ''), p_size) END AS token FROM part",
    "e2_rule_objects": "SELECT p_partkey, regexp_replace(replace(replace(concat(p_type, ' STEEL PLATED ', p_size), 'STEEL PLATED', 'PLATE'), 'STEEL', 'IRON'), '[0-9]+', '#', 'g') AS text, 2 + (length(p_type) - length(replace(p_type, 'STEEL', ''))) // 5 AS n FROM part",
    "e3_fallback_chain": "SELECT p_partkey, 'upper' AS provider, upper(p_type) AS answer FROM part",
    "s15_folder_tree": "WITH f AS (SELECT DISTINCT file_id, folder FROM pdf_file), p AS (SELECT file_id, string_split(folder, '_') AS w FROM f), a AS (SELECT file_id, w, unnest(range(1, len(w) + 1)) AS depth FROM p) SELECT array_to_string(w[1:depth], '/') AS folder, depth, count(*) AS files FROM a GROUP BY 1, 2",
    "s14_listing": "SELECT DISTINCT file_id, lower(trim(name)) AS sort_name FROM pdf_file WHERE ends_with(lower(trim(name)), '.pdf') AND NOT starts_with(trim(name), '~$')",
}
