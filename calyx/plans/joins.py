"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx import runtime
from calyx.functions import identifiers as ids
from calyx.operators import joins, keyed, sets, similar
from calyx.runtime import small, table


def j1_cross_map(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_linestatus", F.col("l_orderkey").alias("ord"), F.when(F.col("l_discount") > 0.01, F.col("l_quantity")).alias("trial"), F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice")).alias("control"), "l_returnflag")
    keys = ["l_suppkey", "l_linenumber", "l_linestatus"]
    cut = lambda flag: rows.where(F.col("l_returnflag") == flag).drop("l_returnflag").groupBy(*keys, "ord").agg(F.max("trial").alias("trial"), F.max("control").alias("control"))
    return joins.complete_match(cut("N"), cut("R"), keys, ["trial", "control"])


def j2_reconcile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    left = rows.where("l_orderkey % 11 <> 0").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))
    right = rows.where("l_orderkey % 13 <> 0").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(F.col("l_orderkey") % 17 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))), 2).alias("q"))
    return joins.reconcile(left, right, ["l_orderkey"], ["n", "q"])


def j3_backfill(spark: SparkSession, d: str) -> DataFrame:
    merged = keyed.merged_fields(table(spark, d, "serology_row").where("file_ord % 2 = 0"), ["sample", "marker"], ["value", "note"], ["file_ord", "row_ord", "serology_id"]).drop("first_seen")
    reference = keyed.merged_fields(table(spark, d, "serology_row").where("file_ord % 2 = 1"), ["sample", "marker"], ["value", "note"], ["file_ord", "row_ord", "serology_id"], prefer_last=False).drop("first_seen")
    return joins.backfill(merged, reference, ["sample", "marker"], ["value", "note"])


def j4_through_alias(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.createDataFrame([("AUTOMOBILE", "MACHINERY"), ("HOUSEHOLD", "FURNITURE")], "alias string, canonical string")
    target = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("term")).agg(F.count(F.lit(1)).alias("customers"))
    return joins.through_alias(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", aliases, target, "term").select("c_custkey", "term", "customers")


def j5_audit(spark: SparkSession, d: str) -> DataFrame:
    expected = table(spark, d, "lineitem").where("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum(F.col("l_extendedprice")), 2).alias("o_totalprice"))
    checked = joins.audit(table(spark, d, "orders"), expected, ["o_orderkey"], "o_totalprice", 50_000.0)
    return checked.select("o_orderkey", "action")


def j6_duplicate_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pdf_file").select("file_id", F.lower("name").alias("low"), F.lower("page1_hash").alias("hash")).distinct()
    by_name = joins.duplicates_by(files, "file_id", F.col("low"), "name")
    by_hash = joins.duplicates_by(files, "file_id", F.when(F.col("hash") != "", F.col("hash")), "first page")
    return by_name.unionByName(by_hash).distinct()


def j7_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """Labels and aliases of the reference list: a table of fixed size."""
    labels = table(spark, d, "canon_value").select("canon_id", F.concat_ws(" ", F.array("label"), "aliases").alias("t"))
    pairs = joins.tfidf_pairs(labels, "canon_id", "t")
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


def j7_slides(spark: SparkSession, d: str) -> DataFrame:
    """All slides by their texts, at the reference's low threshold; one row a pair of text classes, and one a copy."""
    pairs = similar.tfidf_above(table(spark, d, "slide_info"), "global_id", "text_content", 0.6)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


def j8_label_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Parts by how many of a category's labels they name; the three best per category."""
    labels = [("plated", ["PLATED", "STEEL", "BRUSHED"]), ("small", ["SMALL", "TIN", "BURNISHED"]), ("economy", ["ECONOMY", "BRASS", "ANODIZED"])]
    scores = F.array(*[F.struct(F.lit(n).alias("category"), sum((F.col("p_type").contains(w).cast("int") for w in words), F.lit(0)).alias("score")) for n, words in labels])
    long = table(spark, d, "part").select("p_partkey", F.explode(scores).alias("s")).select("p_partkey", "s.category", "s.score").where("score > 0")
    return keyed.top_ranked(long, ["category"], [F.desc("score"), F.asc("p_partkey")], 3)


def _boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    line = table(spark, d, "lineitem")
    items = line.selectExpr("concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', cast(l_quantity as int)) AS item", "l_suppkey AS doc", "l_linenumber AS page", "cast(l_quantity * 2 as double) AS x0", "cast(l_orderkey % 97 as double) AS top", "cast(l_quantity * 2 + 5 as double) AS x1", "cast(l_orderkey % 97 + 3 as double) AS bottom")
    boxes = line.where("l_tax = 0 and l_discount = 0").selectExpr("l_suppkey AS doc", "l_linenumber AS page", "cast(l_quantity as double) AS x0", "cast(l_partkey % 60 as double) AS top", "cast(l_quantity + 30 as double) AS x1", "cast(l_partkey % 60 + 20 as double) AS bottom")
    return items, boxes


def j9_not_overlapping(spark: SparkSession, d: str) -> DataFrame:
    items, boxes = _boxes(spark, d)
    return joins.not_overlapping(items, boxes, ["doc", "page"], 16.0).select("item", "doc", "page")


def j10_looked_back(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    out = joins.looked_back(rows, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")), 5, "tag")
    return out.select("event_id", "tag")


def j11_kept_and_removed(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return sets.kept_and_removed(table(spark, d, "part").select("p_partkey"), used, "p_partkey")


def j12_not_registered(spark: SparkSession, d: str) -> DataFrame:
    registered = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return sets.not_registered(table(spark, d, "customer"), registered, "c_nationkey", F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


def j13_zipped(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    return joins.zipped(a, b, ["nation"], ["c_custkey"], ["s_suppkey"])


def j14_verify(spark: SparkSession, d: str) -> DataFrame:
    """All cells compared, and whether the cell is on the diagonal that a lenient check looks at."""
    rows = table(spark, d, "lineitem")
    cells = rows.select("l_orderkey", "l_linenumber", F.explode(F.array(F.struct(F.lit(1).alias("sub"), (F.col("l_discount") * 10).alias("v")), F.struct(F.lit(2).alias("sub"), (F.col("l_tax") * 10).alias("v")), F.struct(F.lit(3).alias("sub"), (F.col("l_quantity") / 100).alias("v")))).alias("c"))
    cells = cells.select("l_orderkey", "l_linenumber", "c.sub", "c.v")
    means = cells.groupBy("l_linenumber", "sub").agg(F.avg("v").alias("source"))
    from calyx.functions.numbers import close

    checked = cells.join(small(means), ["l_linenumber", "sub"]).withColumn("ok", close(F.col("v"), F.col("source"), 0.15))
    return checked.groupBy("l_linenumber", "sub").agg(F.count_if(~F.col("ok")).alias("mismatches"), F.max((F.col("sub") == F.col("l_linenumber")).cast("int")).alias("diagonal"))


def j16_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey")
    values = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    out = joins.lookup_with_fallback(rows, "p_partkey", values.where("l_returnflag = 'R' and l_quantity > 30"), values.where("l_quantity > 20"), ["l_orderkey", "l_linenumber"], "l_quantity")
    return out.select("p_partkey", "found", "how")


def j18_template_rank(spark: SparkSession, d: str) -> DataFrame:
    """Which brand's part types are found most among the ordered parts, by ratio; the first name wins ties."""
    labels = table(spark, d, "part").select("p_brand", "p_type").distinct()
    found = table(spark, d, "lineitem").where("l_quantity >= 48").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").select("p_type").distinct().withColumn("hit", F.lit(1))
    scored = labels.join(found, "p_type", "left").groupBy("p_brand").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("ratio"))
    return keyed.top_overall(scored, [F.desc("ratio"), F.asc("p_brand")], 1).select("p_brand", F.round("ratio", 6).alias("ratio"))


def j19_in_networks(spark: SparkSession, d: str) -> DataFrame:
    addresses = table(spark, d, "customer").selectExpr("c_custkey", "concat('10.', c_nationkey, '.', c_custkey % 7, '.', c_custkey % 250) AS ip")
    networks = table(spark, d, "nation").selectExpr("cast(10 * 16777216 + n_nationkey * 65536 as bigint) AS base", "CASE WHEN n_nationkey % 2 = 0 THEN 16 ELSE 24 END AS prefix")
    return joins.in_networks(addresses, ids.ip_number(F.col("ip")), networks).select("c_custkey", "network", "prefix")


def j20_inherited(spark: SparkSession, d: str) -> DataFrame:
    """A nation takes the name of the one it is linked to, where it is linked."""
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") + 1).alias("linked"))
    return sets.inherited(n, "n_nationkey", "linked", "name").select("n_nationkey", "name")


def j21_positional(spark: SparkSession, d: str) -> DataFrame:
    """Nations without a customer of their number take the customer at their position; positions out of range are left out."""
    nations, customers = table(spark, d, "nation").select("n_nationkey", "n_regionkey"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    matched = customers.where("c_custkey % 9 = 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").alias("c_custkey")).join(nations.where("n_regionkey < 3").select("n_nationkey"), "n_nationkey")
    rest = nations.join(matched, "n_nationkey", "left_anti")
    numbered = runtime.numbered_within(customers.select("c_custkey"), [], ["c_custkey"], "position")
    by_position = rest.join(numbered, F.col("n_nationkey") == F.col("position")).select("n_nationkey", "c_custkey")
    return matched.select("n_nationkey", "c_custkey", F.lit("rule").alias("how")).unionByName(by_position.withColumn("how", F.lit("position")))


def j22_in_final(spark: SparkSession, d: str) -> DataFrame:
    return sets.marked_as_in(table(spark, d, "slide_info"), table(spark, d, "merge_report").where("decision = 'keep_unique'"), "global_id", "in_final")


def j23_stale_outputs(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "lineitem").where("l_orderkey % 6 <> 0").withColumn("o_orderkey", F.col("l_orderkey"))
    return sets.stale_outputs(table(spark, d, "orders"), made, "o_orderkey", "o_orderdate", "l_shipdate").select("o_orderkey")


def j24_requested(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(x,) for x in ("FRANCE", "GERMANY", "ATLANTIS", "KENYA")], "n_name string")
    return sets.requested(table(spark, d, "nation"), asked, "n_name")


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[0] == "j" and n[1].isdigit()}

_SER = """SELECT sample, marker, arg_{w}(nullif(trim(value), ''), (file_ord, row_ord, serology_id)) FILTER (nullif(trim(value), '') IS NOT NULL) AS value,
    arg_{w}(nullif(trim(note), ''), (file_ord, row_ord, serology_id)) FILTER (nullif(trim(note), '') IS NOT NULL) AS note FROM serology_row WHERE file_ord % 2 = {r} GROUP BY 1, 2"""
_ONE_BY_ONE = """SELECT l_suppkey, l_linenumber, l_linestatus, trial, control FROM (SELECT l_suppkey, l_linenumber, l_linestatus, l_orderkey, max(CASE WHEN l_discount > 0.01 THEN l_quantity END) AS trial, max(CASE WHEN l_tax > 0.01 THEN l_extendedprice END) AS control
    FROM lineitem WHERE l_returnflag = '{f}' GROUP BY 1, 2, 3, 4) QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber, l_linestatus ORDER BY l_orderkey DESC) = 1"""

SQL = {
    "j1_cross_map": f"""WITH a AS ({_ONE_BY_ONE.format(f='N')}), b AS ({_ONE_BY_ONE.format(f='R')}) SELECT l_suppkey, l_linenumber, l_linestatus, a.trial, a.control, b.trial AS target_trial, b.control AS target_control
        FROM a JOIN b USING (l_suppkey, l_linenumber, l_linestatus) WHERE a.trial IS NOT NULL AND a.control IS NOT NULL AND b.trial IS NOT NULL AND b.control IS NOT NULL""",
    "j2_reconcile": """WITH a AS (SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY 1), b AS (SELECT l_orderkey, count(*) AS n, round(sum(CASE WHEN l_orderkey % 17 = 0 THEN l_quantity + 1 ELSE l_quantity END), 2) AS q FROM lineitem WHERE l_orderkey % 13 <> 0 GROUP BY 1)
        SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, a.n AS left_n, a.q AS left_q, b.n AS right_n, b.q AS right_q, CASE WHEN b.n IS NULL THEN 'left' WHEN a.n IS NULL THEN 'right' WHEN a.n = b.n AND a.q = b.q THEN 'same' ELSE 'differs' END AS side FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey""",
    "j3_backfill": f"""WITH a AS ({_SER.format(w='max', r=0)}), b AS ({_SER.format(w='min', r=1)}), j AS (SELECT a.*, a.value IS NULL AND a.note IS NULL AND coalesce(b.value, b.note) IS NOT NULL AS filled, coalesce(b.value, '') AS rv, coalesce(b.note, '') AS rn FROM a LEFT JOIN b USING (sample, marker))
        SELECT sample, marker, CASE WHEN filled THEN rv ELSE value END AS value, CASE WHEN filled THEN rn ELSE note END AS note, filled FROM j""",
    "j4_through_alias": """WITH t AS (SELECT c_mktsegment AS term, count(*) AS customers FROM customer GROUP BY 1), c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'MACHINERY' WHEN 'HOUSEHOLD' THEN 'FURNITURE' ELSE c_mktsegment END AS term FROM customer) SELECT c_custkey, term, customers FROM c JOIN t USING (term)""",
    "j5_audit": """WITH e AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS x FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1) SELECT o_orderkey, CASE WHEN x IS NULL THEN 'SKIP' WHEN abs(o_totalprice - x) <= 50000 THEN 'OK' ELSE 'FIX' END AS action FROM orders LEFT JOIN e ON o_orderkey = l_orderkey""",
    "j6_duplicate_files": """WITH f AS (SELECT DISTINCT file_id, lower(name) AS low, nullif(lower(page1_hash), '') AS hash FROM pdf_file),
        n AS (SELECT min(file_id) OVER (PARTITION BY low) AS first, file_id AS other, 'name' AS reason FROM f WHERE low IS NOT NULL), h AS (SELECT min(file_id) OVER (PARTITION BY hash) AS first, file_id AS other, 'first page' AS reason FROM f WHERE hash IS NOT NULL)
        SELECT DISTINCT * FROM (SELECT * FROM n UNION ALL SELECT * FROM h) WHERE first <> other""",
    "j8_label_candidates": """WITH l AS (SELECT p_partkey, 'plated' AS category, contains(p_type, 'PLATED')::INT + contains(p_type, 'STEEL')::INT + contains(p_type, 'BRUSHED')::INT AS score FROM part UNION ALL SELECT p_partkey, 'small', contains(p_type, 'SMALL')::INT + contains(p_type, 'TIN')::INT + contains(p_type, 'BURNISHED')::INT FROM part
        UNION ALL SELECT p_partkey, 'economy', contains(p_type, 'ECONOMY')::INT + contains(p_type, 'BRASS')::INT + contains(p_type, 'ANODIZED')::INT FROM part) SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, p_partkey) AS rank FROM l WHERE score > 0 QUALIFY rank <= 3""",
    "j9_not_overlapping": """WITH i AS (SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', cast(l_quantity as int)) AS item, l_suppkey AS doc, l_linenumber AS page, l_quantity * 2 AS x0, l_orderkey % 97 AS top, l_quantity * 2 + 5 AS x1, l_orderkey % 97 + 3 AS bottom FROM lineitem),
        b AS (SELECT l_suppkey AS doc, l_linenumber AS page, l_quantity AS x0, l_partkey % 60 AS top, l_quantity + 30 AS x1, l_partkey % 60 + 20 AS bottom FROM lineitem WHERE l_tax = 0 AND l_discount = 0)
        SELECT item, doc, page FROM i WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc = i.doc AND b.page = i.page AND i.x0 <= b.x1 AND i.x1 >= b.x0 AND i.top <= b.bottom AND i.bottom >= b.top)""",
    "j10_looked_back": "WITH t AS (SELECT *, CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END AS g FROM events) SELECT event_id, coalesce(" + ", ".join(f"lag(g, {i}) OVER w" for i in range(1, 6)) + ") AS tag FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "j11_kept_and_removed": "SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) THEN 'kept' ELSE 'removed' END AS state FROM part",
    "j12_not_registered": "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
    "j13_zipped": "WITH a AS (SELECT c_nationkey AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS position FROM customer), b AS (SELECT s_nationkey AS nation, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS position FROM supplier) SELECT * FROM a JOIN b USING (nation, position)",
    "j14_verify": """WITH c AS (SELECT l_linenumber, 1 AS sub, l_discount * 10 AS v FROM lineitem UNION ALL SELECT l_linenumber, 2, l_tax * 10 FROM lineitem UNION ALL SELECT l_linenumber, 3, l_quantity / 100 FROM lineitem), m AS (SELECT l_linenumber, sub, avg(v) AS s FROM c GROUP BY 1, 2)
        SELECT l_linenumber, sub, count(*) FILTER (abs(v - s) > 0.15) AS mismatches, (sub = l_linenumber)::INT AS diagonal FROM c JOIN m USING (l_linenumber, sub) GROUP BY 1, 2""",
    "j16_lookup": """WITH e AS (SELECT l_partkey, arg_min(l_quantity, (l_orderkey, l_linenumber)) AS v FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30 GROUP BY 1), a AS (SELECT l_partkey, arg_min(l_quantity, (l_orderkey, l_linenumber)) AS v FROM lineitem WHERE l_quantity > 20 GROUP BY 1)
        SELECT p_partkey, coalesce(e.v, a.v) AS found, CASE WHEN e.v IS NOT NULL THEN 'exact' WHEN a.v IS NOT NULL THEN 'fallback' ELSE 'none' END AS how FROM part LEFT JOIN e ON p_partkey = e.l_partkey LEFT JOIN a ON p_partkey = a.l_partkey""",
    "j18_template_rank": """WITH f AS (SELECT DISTINCT p_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 48), l AS (SELECT DISTINCT p_brand, p_type FROM part) SELECT p_brand, round(avg((p_type IN (SELECT p_type FROM f))::INT), 6) AS ratio FROM l GROUP BY 1 ORDER BY avg((p_type IN (SELECT p_type FROM f))::INT) DESC, 1 LIMIT 1""",
    "j19_in_networks": """SELECT c_custkey, 10 * 16777216 + c_nationkey * 65536 AS network, CASE WHEN c_nationkey % 2 = 0 THEN 16 ELSE 24 END AS prefix FROM customer WHERE c_nationkey % 2 = 0 OR c_custkey % 7 = 0""",
    "j20_inherited": "SELECT n.n_nationkey, coalesce(m.n_name, n.n_name) AS name FROM nation n LEFT JOIN nation m ON n.n_nationkey % 3 = 0 AND m.n_nationkey = n.n_nationkey + 1",
    "j21_positional": """WITH c AS (SELECT c_custkey, c_nationkey FROM customer), m AS (SELECT c_nationkey AS n_nationkey, min(c_custkey) AS c_custkey FROM c WHERE c_custkey % 9 = 0 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY 1), p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS position FROM c)
        SELECT *, 'rule' AS how FROM m UNION ALL SELECT n_nationkey, c_custkey, 'position' FROM nation JOIN p ON n_nationkey = position WHERE n_nationkey NOT IN (SELECT n_nationkey FROM m)""",
    "j22_in_final": "SELECT DISTINCT global_id, CASE WHEN global_id IN (SELECT global_id FROM merge_report WHERE decision = 'keep_unique' AND global_id IS NOT NULL) THEN 'yes' ELSE 'no' END AS in_final FROM slide_info",
    "j23_stale_outputs": "WITH m AS (SELECT l_orderkey, min(l_shipdate) AS made FROM lineitem WHERE l_orderkey % 6 <> 0 GROUP BY 1) SELECT o_orderkey FROM orders LEFT JOIN m ON o_orderkey = l_orderkey WHERE made IS NULL OR made < o_orderdate",
    "j24_requested": "WITH a AS (SELECT unnest(['FRANCE', 'GERMANY', 'ATLANTIS', 'KENYA']) AS n_name) SELECT n_name, CASE WHEN n_name IN (SELECT n_name FROM nation) THEN 'selected' ELSE 'missing' END AS state FROM a",
}
_G = "list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))"
SQL["j7_tfidf"] = rf"""WITH d AS (SELECT canon_id AS id, regexp_extract_all(regexp_replace(lower(concat_ws(' ', label, array_to_string(aliases, ' '))), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM canon_value),
    t AS (SELECT id, unnest({_G}) AS term FROM d WHERE len(w) > 0), f AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2),
    v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM f GROUP BY 1 ORDER BY total DESC, term LIMIT 5000), n AS (SELECT count(DISTINCT canon_id) AS n FROM canon_value),
    x AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM f JOIN v USING (term), n), z AS (SELECT id, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1), u AS (SELECT id, term, w / norm AS w FROM x JOIN z USING (id))
    SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS similarity FROM u a JOIN u b USING (term) WHERE a.id < b.id GROUP BY 1, 2"""
SQL["j7_slides"] = rf"""WITH d AS (SELECT global_id AS id, regexp_extract_all(lower(max(text_content)), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM slide_info WHERE global_id IS NOT NULL GROUP BY 1),
    t AS (SELECT id, unnest({_G}) AS term FROM d WHERE len(w) > 0), f AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2),
    v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM f GROUP BY 1 ORDER BY total DESC, term LIMIT 5000), n AS (SELECT count(*) AS n FROM d),
    g AS (SELECT id, list_reduce(list(tf), lambda x, y: gcd(x, y)) AS g FROM f JOIN v USING (term) GROUP BY 1), k AS (SELECT id, list((term, tf // g) ORDER BY term) AS vector FROM f JOIN v USING (term) JOIN g USING (id) GROUP BY 1),
    c AS (SELECT id, min(id) OVER (PARTITION BY vector) AS first FROM k),
    x AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM f JOIN v USING (term) JOIN c USING (id), n WHERE id = first), z AS (SELECT id, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1), u AS (SELECT id, term, w / norm AS w FROM x JOIN z USING (id))
    SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS similarity FROM u a JOIN u b USING (term) WHERE a.id < b.id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.6 UNION ALL SELECT first, id, 1.0 FROM c WHERE first <> id"""
