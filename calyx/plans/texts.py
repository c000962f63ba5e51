"""Queries of titles, replacements, snippets, scanned lines, JSON and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx.functions import geometry, texts, titles
from calyx.runtime import table

_RULES = texts.Rules([("the", "THE"), ("the blinded", "the open")], [(r"\d+", "#"), ("booster", "dose")])


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def f4_scanned_line(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "serology_row").where("sample is not null and marker is not null").selectExpr(
        "serology_id", "CASE serology_id % 4 WHEN 0 THEN concat(serology_id % 900, '—M1_a <2.00 mIU/ml 阴性 ', serology_id % 50, '.5 阳') WHEN 1 THEN concat(serology_id % 90, ' | ', serology_id % 900, '-MI-a | 1.5 | n | <2 IU | 阴性 | 3 | | 4 | x | 5 | y |') WHEN 2 THEN '725-M1-a no numbers' ELSE 'x' END AS line"
    )
    out = lines.select("serology_id", texts.scanned_line(F.col("line")).alias("r"))
    pair = lambda i, f: F.get("r.pairs", F.lit(i))[f]
    return out.select("serology_id", F.col("r.sample").alias("sample"), pair(0, "value").alias("value1"), pair(0, "note").alias("note1"), pair(1, "value").alias("value2"), pair(1, "note").alias("note2"))


def f5_clean_value(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "serology_row").select("serology_id", texts.clean_value(F.col("value")).alias("value"))


def f8_title_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", titles.title_case(F.concat_ws(" of ", F.lower("p_type"), F.lower("p_name"))).alias("title"))


def f9_before_colon(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ': a ', p_type, ' trial') WHEN 1 THEN concat(p_name, ': ', p_type) ELSE concat(p_name, '：', p_type) END AS t")
    return names.select("p_partkey", titles.before_colon(F.col("t")).alias("head"))


def f12_file_name(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "slide_info").select("global_id", "title").where("title is not null").distinct()
    return rows.select("global_id", titles.file_name(F.col("title")).alias("file_name"))


def f13_line_kinds(spark: SparkSession, d: str) -> DataFrame:
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", r"\n")).alias("at", "line"))
    return lines.select("doc_id", "at", titles.line_kind(F.col("line")).alias("kind"))


def f14_year(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 6 WHEN 0 THEN concat('Vaccine 31 (20', 10 + o_orderkey % 10, ') 1870-1876') WHEN 1 THEN concat('Published online in 19', 90 + o_orderkey % 10) WHEN 2 THEN 'no year' WHEN 3 THEN concat('seen in 20', 10 + o_orderkey % 10, ' once') WHEN 4 THEN 'none' ELSE 'n' END AS head", "CASE o_orderkey % 6 WHEN 4 THEN 'Docket FDA-2019-D-1234' ELSE '' END AS payload", "CASE o_orderkey % 6 WHEN 5 THEN 'D:20170101' ELSE '' END AS created")
    return rows.select("o_orderkey", titles.publication_year(F.col("head"), F.col("payload"), F.col("created")).alias("year"))


def f15_arbitrated_title(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "slide_info").select("global_id", "title", "text_content", "source_ppt").distinct()
    first = F.substring_index("text_content", "\n", 1)
    out = titles.arbitrated_title([(F.col("title"), 10.0), (first, 8.0), (F.col("source_ppt"), 5.0), (F.col("text_content"), 0.0)], F.coalesce("title", F.lit("")))
    return rows.select("global_id", F.md5(out).alias("title"))


def f18_replace_rules(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, d).select("doc_id", F.md5(_RULES.apply(text)).alias("text"), _RULES.count(text).alias("counted"), _RULES.replaced(text).alias("replaced"))


def f19_written_back(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.array("p_brand", "p_type", "p_name").alias("runs"))
    text = F.when(F.col("p_partkey") % 2 == 0, F.upper(F.array_join("runs", ""))).otherwise(F.concat(F.array_join("runs", ""), F.lit("!")))
    return rows.select("p_partkey", F.array_join(texts.written_back(F.col("runs"), text), "|").alias("runs"))


def a24_replacement_counts(spark: SparkSession, d: str) -> DataFrame:
    before, after = _RULES.count(F.col("text")), _RULES.count(_RULES.apply(F.col("text")))
    return _docs(spark, d).groupBy("source").agg(F.sum(before).alias("before"), F.sum(after).alias("after")).withColumn("replaced", F.col("before") - F.col("after"))


def f26_json_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN concat('```json\\n', props, '\\n```') WHEN 1 THEN concat('Here it is: ', props, ' done') WHEN 2 THEN props ELSE 'nothing' END AS answer")
    return rows.select("event_id", F.md5(texts.json_text(F.col("answer"))).alias("json"))


def f27_required_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", texts.required_first(F.col("props"), ["k", "missing"]).alias("r"))
    return rows.select("event_id", F.col("r.fields.k").alias("k"), F.col("r.fields.missing").alias("missing"), F.size("r.extra").alias("extras"))


def f28_snippets(spark: SparkSession, d: str) -> DataFrame:
    found = _docs(spark, d).select("doc_id", F.posexplode(texts.snippets(F.col("text"), "booster", 30)).alias("hit", "snippet"))
    return found.select("doc_id", "hit", F.md5("snippet").alias("snippet"))


def w7_misaligned_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The report's older form: what follows hit i, then what follows hit i + 1."""
    found = _docs(spark, d).select("doc_id", F.posexplode(texts.snippets(F.col("text"), "booster", 30, misaligned=True)).alias("hit", "snippet"))
    return found.select("doc_id", "hit", F.md5("snippet").alias("snippet"))


def f29_keyword_windows(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(texts.keyword_windows(F.col("text"), ["booster", "deviation"], 90, 400, 6000)).alias("kept"))


def f36_geometry(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_quantity AS x0", "cast(l_linenumber * 10 as double) AS top", "l_quantity + 20.0D AS x1", "cast(l_linenumber * 10 + 15 as double) AS bottom")
    b = geometry.box(F.col("x0"), F.col("top"), F.col("x1"), F.col("bottom"))
    turned = geometry.rotated(b, (F.col("l_partkey") % 4 * 90).cast("int"), F.lit(0), F.lit(60.0), F.lit(80.0))
    shown = geometry.clamped(turned, F.lit(60.0), F.lit(60.0))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(geometry.area(shown), 4).alias("area"), geometry.overlaps(turned, geometry.box(F.lit(0), F.lit(0), F.lit(30), F.lit(30))).alias("meets"))


def f21_series_colour(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_brand").distinct().select("p_brand", geometry.series_colour(F.col("p_brand"), {"brand#11": "1F77B4", "brand#22": "FF7F0E"}).alias("colour"))


def f37_bookmark_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "slide_info").select("global_id", F.md5(texts.bookmark_title(F.col("text_content"))).alias("title")).distinct()


def f43_warning_summary(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.length(texts.warning_summary(F.col("text"))).alias("chars"))


def f44_fallback_title(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(titles.fallback_title(F.lit(""), F.when(F.col("doc_id") % 3 == 0, "Microsoft Word - x").otherwise(""), F.col("text"))).alias("title"))


def k1_cell_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(texts.cell_text(F.col("text"), 500)).alias("cell"))


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[0] in "afkw" and n[1].isdigit()}

_SMALL = ", ".join(f"'{w}'" for w in titles.SMALL_WORDS)
_RUN = "replace(replace(text, 'the blinded', 'the open'), 'the', 'THE')"
_ALL = f"regexp_replace(regexp_replace({_RUN}, '\\d+', '#', 'g'), 'booster', 'dose', 'g')"
_CNT = "len(regexp_extract_all({t}, 'the blinded')) + len(regexp_extract_all({t}, 'the')) + len(regexp_extract_all({t}, '\\d+')) + len(regexp_extract_all({t}, 'booster'))"
_PIECES = "string_split(replace(text, chr(10), ' '), 'booster')"

SQL = {
    "f4_scanned_line": """SELECT serology_id, CASE serology_id % 4 WHEN 0 THEN concat(serology_id % 900, '-M1-a') WHEN 1 THEN concat(serology_id % 900, '-M1-a') END AS sample, CASE serology_id % 4 WHEN 0 THEN '<2.00' WHEN 1 THEN '1.5' END AS value1, CASE serology_id % 4 WHEN 0 THEN '阴性' WHEN 1 THEN 'n' END AS note1,
        CASE serology_id % 4 WHEN 0 THEN concat(serology_id % 50, '.5') WHEN 1 THEN '<2' END AS value2, CASE serology_id % 4 WHEN 0 THEN '阳性' WHEN 1 THEN '阴性' END AS note2 FROM serology_row WHERE sample IS NOT NULL AND marker IS NOT NULL""",
    "f5_clean_value": r"WITH s AS (SELECT serology_id, trim(coalesce(value, '')) AS v FROM serology_row) SELECT serology_id, coalesce(nullif(regexp_extract(v, '^([<≥\d.]+)', 1), ''), split_part(v, ' ', 1)) AS value FROM s",
    "f8_title_case": f"""WITH s AS (SELECT p_partkey, list_filter(string_split(regexp_replace(concat(lower(p_type), ' of ', lower(p_name)), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM part)
        SELECT p_partkey, array_to_string(list_transform(w, lambda x, i: CASE WHEN x IN ({_SMALL}) AND i > 1 AND i < len(w) THEN x WHEN regexp_matches(x, '\\d') AND regexp_matches(x, '[a-z]') THEN x ELSE concat(upper(x[1]), x[2:]) END), ' ') AS title FROM s""",
    "f9_before_colon": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ': a ', p_type, ' trial') ELSE p_name END AS head FROM part",
    "f14_year": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat('20', 10 + o_orderkey % 10) WHEN 1 THEN concat('19', 90 + o_orderkey % 10) WHEN 2 THEN 'XXXX' WHEN 3 THEN concat('20', 10 + o_orderkey % 10) WHEN 4 THEN '2019' ELSE '2017' END AS year FROM orders",
    "f18_replace_rules": f"""SELECT doc_id, md5({_ALL}) AS text, {_CNT.format(t='text')} AS counted,
        len(regexp_extract_all(text, 'the blinded')) + len(regexp_extract_all(replace(text, 'the blinded', 'the open'), 'the')) + len(regexp_extract_all({_RUN}, '\\d+')) + len(regexp_extract_all(regexp_replace({_RUN}, '\\d+', '#', 'g'), 'booster')) AS replaced FROM documents""",
    "f19_written_back": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(concat(p_brand, '|', p_type, '|', p_name)) ELSE concat(p_brand, p_type, p_name, '!||') END AS runs FROM part",
    "a24_replacement_counts": f"SELECT source, sum({_CNT.format(t='text')})::BIGINT AS before, sum({_CNT.format(t=_ALL)})::BIGINT AS after, (sum({_CNT.format(t='text')}) - sum({_CNT.format(t=_ALL)}))::BIGINT AS replaced FROM documents GROUP BY 1",
    "f26_json_text": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN md5(props) END AS json FROM events",
    "f27_required_first": "SELECT event_id, props->>'k' AS k, NULL::VARCHAR AS missing, len(list_filter(json_keys(props), lambda x: x <> 'k')) AS extras FROM events",
    "f28_snippets": f"""WITH p AS (SELECT doc_id, {_PIECES} AS p FROM documents), i AS (SELECT doc_id, p, unnest(range(2, len(p) + 1)) AS i FROM p WHERE len(p) > 1) SELECT doc_id, i - 2 AS hit, md5(trim(concat(right(p[i - 1], 30), 'booster', left(p[i], 30)))) AS snippet FROM i""",
    "w7_misaligned_snippets": f"""WITH p AS (SELECT doc_id, {_PIECES} AS p FROM documents), i AS (SELECT doc_id, p, unnest(range(2, len(p) + 1)) AS i FROM p WHERE len(p) > 1) SELECT doc_id, i - 2 AS hit, md5(trim(left(concat(right(p[i], 30), 'booster', left(coalesce(p[i + 1], ''), 30)), 60))) AS snippet FROM i""",
    "f37_bookmark_title": "SELECT DISTINCT global_id, md5(left(trim(regexp_replace(regexp_replace(text_content, '[\\x00-\\x1F]', ' ', 'g'), '[\\s\\x{3000}\\x{A0}\\x{2009}\\x{202F}]+', ' ', 'g')), 180)) AS title FROM slide_info",
    "f43_warning_summary": r"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS w FROM documents),
        d AS (SELECT doc_id, text, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM l) SELECT doc_id, CASE WHEN text IS NOT NULL THEN least(length(coalesce(array_to_string(w, '; '), '')), 500) END AS chars FROM d""",
    "f44_fallback_title": r"""WITH l AS (SELECT doc_id, list_filter((string_split(text, chr(10)))[1:15], lambda x: length(trim(x, ' ')) >= 5) AS w FROM documents) SELECT doc_id, md5(trim(w[1], ' ')) AS title FROM l""",
    "k1_cell_text": "SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN concat(left(text, 497), '...') ELSE text END) AS cell FROM documents",
    "f36_geometry": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x0, l_linenumber * 10.0::DOUBLE AS t, l_quantity + 20 AS x1, l_linenumber * 10.0::DOUBLE + 15 AS b FROM lineitem),
        q AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 4 WHEN 0 THEN x0 WHEN 1 THEN t WHEN 2 THEN 60 - x1 ELSE 80 - b END AS x0, CASE l_partkey % 4 WHEN 0 THEN x1 WHEN 1 THEN b WHEN 2 THEN 60 - x0 ELSE 80 - t END AS x1,
          CASE l_partkey % 4 WHEN 0 THEN t WHEN 1 THEN 60 - x1 WHEN 2 THEN 80 - b ELSE x0 END AS t, CASE l_partkey % 4 WHEN 0 THEN b WHEN 1 THEN 60 - x0 WHEN 2 THEN 80 - t ELSE x1 END AS b FROM r),
        c AS (SELECT *, greatest(0, least(x0, 60)) AS cx0, greatest(0, least(x1, 60)) AS cx1, greatest(0, least(t, 60)) AS ct, greatest(0, least(b, 60)) AS cb FROM q)
        SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN cx1 > cx0 AND cb > ct THEN (cx1 - cx0) * (cb - ct) ELSE 0 END, 4) AS area, x1 >= 0 AND x0 <= 30 AND b >= 0 AND t <= 30 AS meets FROM c""",
}


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def _held(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


#: The kind of a line ``s`` with its compressed form ``c``, by the same fixed values.
_SPACED = "|".join(r"\s+".join(k) for k in titles.SPACED_KINDS)
_AUTHORS = r"[*∗]\s*$|@|\b[A-Z][a-z]+\s+[A-Z][a-z]+\s+[a-f1-9](?:,|$)"
_KIND = f"""CASE WHEN s = '' THEN 'blank'
    WHEN c IN ({_quoted(titles.STATUS_LINES)}) OR (contains(c, 'articleinpress') AND length(c) <= 24) THEN 'status'
    WHEN {_matches("s", "(?i)^please[ ]+cite[ ]+this[ ]+article".replace("[ ]", chr(92) + "s"))} OR ({_matches("s", titles.CITATION)} AND length(s) < 200) THEN 'citation'
    WHEN {_matches("s", "|".join(titles.VOLUME))} THEN 'volume'
    WHEN lower(s) IN ({_quoted(titles.ARTICLE_KINDS)}) OR {_matches("lower(s)", f"^(?:{_SPACED})$")} THEN 'kind'
    WHEN {_held("c", [x.replace(" ", "") for x in titles.METADATA_PHRASES])} THEN 'metadata'
    WHEN c IN ({_quoted(titles.MASTHEADS)}) OR (len(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '')) <= 5 AND length(s) <= 48 AND NOT {_matches("s", "[.?:;]$")} AND (ends_with(c, 'journal') OR {_held("c", ("journalof", "infections"))} OR contains(s, '&'))) THEN 'masthead'
    WHEN {_matches("s", "(?i)^(?:" + "|".join(titles.FRAME_STARTS) + ")")} OR {_held("c", titles.FRAME_WORDS)} OR {_matches("s", "^[A-Z]{2,6}[ ]+[0-9]{4,6}[ ]+[0-9]|^(?i:G[ ]+Model)".replace("[ ]", chr(92) + "s") + chr(92) + "b")} THEN 'boilerplate'
    WHEN length(s) <= 280 AND ({_matches("s", _AUTHORS)} OR ({_matches("s", r"^[A-Z][\w\-.']+(?:\s*,\s*[A-Z][\w\-.']*)+")} AND length(s) < 120)
        OR ({_matches("s", r"^[A-Z][a-z'\-]{2,24}(?:\s+[A-Z][a-z'\-]{2,24}){1,4}$")} AND length(s) <= 80 AND NOT {_matches("s", "(?i)(?:^|" + chr(92) + "s)(?:" + "|".join(titles.NO_SURNAMES) + ")(?:" + chr(92) + "s|$)| of ")})) THEN 'authors' END"""
_LINE = r"regexp_replace(line, '^[\s\p{Z}\x0b\x1c-\x1f\x85]+|[\s\p{Z}\x0b\x1c-\x1f\x85]+$', '', 'g') AS s, regexp_replace(lower(line), '[^\p{L}\p{M}\p{N}\p{Pc}]+', '', 'g') AS c"
SQL["f13_line_kinds"] = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS "at" FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, "at", {_LINE} FROM l)
    SELECT doc_id, "at", {_KIND} AS kind FROM n"""
SQL["f17_plain_title"] = f"""WITH d AS (SELECT DISTINCT global_id, coalesce(text_content, '') AS t FROM slide_info), l AS (SELECT global_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS "at" FROM d),
    n AS (SELECT global_id, "at", {_LINE} FROM l), k AS (SELECT *, {_KIND} AS kind FROM n),
    w AS (SELECT *, coalesce(max((kind IS NULL)::INT) OVER (p ROWS UNBOUNDED PRECEDING), 0) AS seen, coalesce(max((kind IS NULL)::INT) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM k WINDOW p AS (PARTITION BY global_id ORDER BY "at")),
    e AS (SELECT *, (seen = 1 AND NOT (kind IS NOT NULL AND kind NOT IN ('blank', 'authors')) AND (coalesce(kind IN ('blank', 'authors'), false) OR (length(s) < 220 AND regexp_matches(s, '^[^,]*,[^,]*,') AND regexp_matches(s, ',\\s*[A-Z][a-z]')) OR regexp_matches(s, '(?i)@|https?://|^doi[: ]|^citation:') OR (begun = 1 AND regexp_matches(s, '^[0-9]+\\s+'))))::INT AS ends FROM w),
    g AS (SELECT *, max(ends) OVER (PARTITION BY global_id ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS stop FROM e), q AS (SELECT global_id, "at", trim(regexp_replace(s, '(?i)^Q[0-9]+\\b\\s*', '')) AS s FROM g WHERE seen = 1 AND stop = 0 AND kind IS NULL),
    z AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY global_id ORDER BY "at" ROWS UNBOUNDED PRECEDING) - length(s) - 1 AS before FROM q WHERE s <> ''), j AS (SELECT global_id, regexp_replace(string_agg(s, ' ' ORDER BY "at"), '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g') AS title FROM z WHERE before <= 520 GROUP BY 1)
    SELECT global_id, md5(title) AS title FROM j WHERE length(title) >= 20"""
