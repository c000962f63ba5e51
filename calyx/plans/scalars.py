"""Queries of the scalar functions, over texts built from columns of the base tables.

The text expressions are written in SQL that Spark and DuckDB read alike, so both
sides parse the same noisy values; the parsing itself is independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx.functions import identifiers as ids
from calyx.functions import numbers as num
from calyx.runtime import table

_KEY = "l_orderkey, l_linenumber"
_Q = "cast(l_quantity as int)"
_ESTIMATE = f"""CASE l_orderkey % 5 WHEN 0 THEN concat({_Q}, '.5(', l_linenumber, ', ', l_suppkey, '.25)')
    WHEN 1 THEN concat({_Q}, ' ( ', l_linenumber, '.0 ,', l_suppkey, ')') WHEN 2 THEN concat('  ', {_Q}, '.75')
    WHEN 3 THEN concat({_Q}, '.1.2(', l_linenumber, ', 3)') ELSE 'n.d.' END"""
_RATE = f"CASE l_orderkey % 4 WHEN 0 THEN concat({_Q}, ' (', l_linenumber, '.50)') WHEN 1 THEN concat({_Q}, '') WHEN 2 THEN '' ELSE 'none' END"
_TRIPLE = f"""CASE l_orderkey % 5 WHEN 0 THEN concat({_Q}, '.5（', l_linenumber, '，', l_suppkey, '.2）mIU/mL')
    WHEN 1 THEN concat({_Q}, '.00%(', l_linenumber, '.73%, ', l_suppkey, '.00%)') WHEN 2 THEN concat('about ', {_Q})
    WHEN 3 THEN concat(l_linenumber, '%（1%，2%） and 9（8，7）') ELSE 'none' END"""
_COUNT = f"CASE l_orderkey % 5 WHEN 0 THEN concat(' ', {_Q}, ' ( ', l_linenumber, '.00)') WHEN 1 THEN '-' WHEN 2 THEN '  ' WHEN 3 THEN concat({_Q}, '.9') ELSE 'x' END"
_SAMPLE = """CASE o_orderkey % 6 WHEN 0 THEN concat(o_custkey, '-D', o_orderkey % 10, '-A') WHEN 1 THEN concat(' ', o_orderkey % 90, ' – m', o_orderkey % 9, '_b ')
    WHEN 2 THEN concat('O', o_orderkey % 9, 'l-dO-C') WHEN 3 THEN concat(o_orderkey % 100, '--mI-', 'Z') WHEN 4 THEN 'ab-cd' ELSE '' END"""
_ADDRESS = "concat(CASE p_partkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'aa' WHEN 2 THEN '$XFD$' ELSE '7' END, p_size)"
_RANGE = "CASE p_partkey % 3 WHEN 0 THEN concat('''Sheet ', p_size, '''!$B$', p_size, ':$AA$', p_size % 7 + 1) WHEN 1 THEN concat('Data!C', p_size) ELSE 'broken' END"
_QUERY = """CASE o_orderkey % 6 WHEN 0 THEN concat('https://doi.org/10.1371/journal.pone.', o_custkey) WHEN 1 THEN concat('10.1016/j.vaccine.', o_orderkey)
    WHEN 2 THEN concat('PMID: 1', o_orderkey % 900000 + 100000) WHEN 3 THEN concat('https://pubmed.ncbi.nlm.nih.gov/2', o_orderkey % 900000 + 100000, '/')
    WHEN 4 THEN concat('.1038/s41586-', o_custkey) ELSE concat('a title ', o_orderkey) END"""
_URL = "CASE o_orderkey % 5 WHEN 0 THEN concat('https://host/', o_custkey) WHEN 1 THEN ' JavaScript:alert(1)' WHEN 2 THEN 'vbscript:x' WHEN 3 THEN 'https://h/?q=<SCRIPT>' ELSE 'file:///c' END"
_HTML = """CASE c_custkey % 5 WHEN 0 THEN concat('<a href="/files/', c_custkey, '.pdf">x</a>') WHEN 1 THEN concat('<iframe src=''a/', c_custkey, '.pdf?v=1''>')
    WHEN 2 THEN '<a HREF="https://cdn.x/y.PDF">' WHEN 3 THEN '<a href="//m.x/z.pdf"><a href="b.pdf">' ELSE '<a href="b.html">' END"""
_IP = "concat(CASE c_custkey % 4 WHEN 0 THEN '10' WHEN 1 THEN '172' WHEN 2 THEN '192' ELSE '300' END, '.', CASE c_custkey % 3 WHEN 0 THEN 168 ELSE 20 END, '.', c_nationkey, '.', c_custkey % 256)"


def _keyed(source: str, keys: str, text: str, **outputs):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).selectExpr(*keys.split(", "), f"{text} AS _text")
        return rows.select(*keys.split(", "), *[make(F.col("_text")).alias(name) for name, make in outputs.items()])

    return query


def _field(make, name: str):
    return lambda t: make(t)[name]


def _series_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of a part is a proportion if 70 % of its values lie in 0 to 1; then values above are percentages."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") * F.when(F.col("l_orderkey") % 7 == 0, 100).otherwise(F.when(F.col("l_partkey") % 3 == 0, 50).otherwise(1))).alias("v"))
    share = rows.groupBy("l_partkey").agg((F.avg(F.col("v").between(0, 1).cast("int")) >= 0.7).alias("is_proportion"))
    joined = rows.join(share, "l_partkey")
    return joined.select("l_orderkey", "l_linenumber", F.round(num.as_fraction(F.col("v"), F.col("is_proportion")), 6).alias("scaled"))


def _throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    size = F.col("l_extendedprice") * 4096
    return rows.select("l_orderkey", "l_linenumber", num.throughput_mbps(F.floor(size), F.col("l_quantity")).alias("mbps"),
                       num.readable_size(F.when(F.col("l_linenumber") == 1, F.floor(size / 1000)).otherwise(F.floor(size))).alias("size"))


def _axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    return rows.select("l_returnflag", num.axis_bounds(F.col("lo"), F.col("hi"), 0.1, 500.0).alias("b")).select("l_returnflag", F.col("b.low").alias("axis_low"), F.col("b.high").alias("axis_high"))


def _natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat(c_mktsegment, ' ', c_custkey % 1000, '-', c_nationkey) AS name")
    return rows.select("c_custkey", ids.natural_key(F.col("name")).alias("sort_key"))


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", f"{_IP} AS ip", "CASE c_custkey % 5 WHEN 0 THEN array(22) WHEN 1 THEN array(80, 9100) WHEN 2 THEN array(554, 80) WHEN 3 THEN array(443) ELSE array(7) END AS ports",
        "concat(CASE c_custkey % 3 WHEN 0 THEN '00' WHEN 1 THEN '01' ELSE 'A2' END, '-5e-10-00-00-', c_custkey % 90 + 10) AS mac",
    )
    return rows.select(
        "c_custkey", ids.device_role(F.col("ip"), F.lit("10.168.0.0"), F.lit("192.20.1.1"), F.col("ports")).alias("role"),
        ids.is_private_ip(F.col("ip")).alias("private"), ids.is_unicast_mac(F.col("mac")).alias("unicast"), ids.ip_number(F.col("ip")).alias("ip_number"),
    )


def _documents(**outputs):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "documents")
        return rows.select("doc_id", *[make(F.col("text")).alias(name) for name, make in outputs.items()])

    return query


def _md5(c: Column) -> Column:
    return F.md5(c)


QUERIES = {
    "pr1_estimate": _keyed("lineitem", _KEY, _ESTIMATE, mean=_field(num.estimate, "mean"), upper=_field(num.estimate, "upper"), lower=_field(num.estimate, "lower")),
    "pr2_rate_percent": _keyed("lineitem", _KEY, _RATE, rate=num.rate_percent),
    "pr3_interval": _keyed("lineitem", _KEY, _ESTIMATE, lower=_field(num.interval, "lower"), upper=_field(num.interval, "upper")),
    "pr4_triple": _keyed("lineitem", _KEY, _TRIPLE, lo=_field(num.triple, "lo"), mid=_field(num.triple, "mid"), up=_field(num.triple, "up")),
    "pr5_count_and_share": _keyed("lineitem", _KEY, _COUNT, n=_field(num.count_and_share, "n"), share=_field(num.count_and_share, "share")),
    "pr6_event_count": _keyed("lineitem", _KEY, _COUNT, events=num.event_count),
    "pr12_first_number": _keyed("lineitem", _KEY, _TRIPLE, value=num.first_number),
    "pr13_series_scale": _series_scale,
    "pr14_tidy_number": _keyed("lineitem", _KEY, "l_extendedprice", shown=num.tidy),
    "pr26_query_kind": _keyed("orders", "o_orderkey", _QUERY, kind=ids.query_kind),
    "pr27_query_ids": _keyed("orders", "o_orderkey", _QUERY, doi=ids.doi_of, pmid=ids.pmid_of),
    "pr25_url_risk": _keyed("orders", "o_orderkey", _URL, risk=ids.url_risk),
    "pr29_first_pdf_link": _keyed("customer", "c_custkey", _HTML, link=lambda h: ids.first_pdf_link(h, F.lit("https://site.org/papers/page?x=1"))),
    "pr30_egress_risk": _keyed("customer", "c_custkey", "CASE c_nationkey % 4 WHEN 0 THEN 'DE' WHEN 1 THEN ' de ' WHEN 2 THEN '' ELSE 'FR' END", risk=lambda c: ids.egress_risk(c, F.lit("de"))),
    "pr31_device_role": _roles,
    "pr33_throughput": _throughput,
    "pr34_link_fault": _keyed("orders", "o_orderkey", _URL, fault=lambda u: ids.link_fault(F.when(u.startswith("file"), "launch").otherwise("uri"), u, F.lit(None).cast("string"))),
    "f1_squeeze": _documents(squeezed=lambda t: F.md5(ids.squeeze(F.translate(t, "　\xa0   ", "     ")))),
    "f2_sample_id": _keyed("orders", "o_orderkey", _SAMPLE, sample=ids.sample_id),
    "f3_scanned_sample_id": _keyed("orders", "o_orderkey", _SAMPLE, sample=ids.scanned_sample_id),
    "f20_series_key": _keyed("part", "p_partkey", "concat(p_brand, ' (n=', p_size, ')（', p_type, '） GMC')", series=ids.series_key),
    "f23_natural_key": _natural,
    "f24_safe_name": _keyed("part", "p_partkey", "CASE WHEN p_size % 9 = 0 THEN ' / ' ELSE concat(p_name, ' / ', p_type, '?') END", file_name=lambda t: ids.safe_name(t, 20)),
    "f25_text_hash": _documents(hash=_md5),
    "f30_axis_bounds": _axis,
    "f34_han_count": _documents(han=ids.han_count),
    "f33_translated": _keyed("documents", "doc_id", "text", good=lambda t: ids.is_translated(F.lit("source"), t)),
    "f35_masked": _keyed("customer", "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN 'short' ELSE c_name END", shown=ids.masked),
    "f40_cell_range": _keyed("part", "p_partkey", _RANGE, sheet=_field(ids.cell_range, "sheet"), min_row=_field(ids.cell_range, "min_row"), max_row=_field(ids.cell_range, "max_row"), min_col=_field(ids.cell_range, "min_col"), max_col=_field(ids.cell_range, "max_col")),
    "f41_part_number": _keyed("part", "p_partkey", "CASE p_partkey % 3 WHEN 0 THEN concat('Table Part_', p_size, ' v2.docx') WHEN 1 THEN concat('第', p_size, '部分.docx') ELSE 'plain.docx' END", part=ids.part_number),
    "k2_cell_address": _keyed("part", "p_partkey", _ADDRESS, row=_field(ids.cell_address, "row"), col=_field(ids.cell_address, "col")),
    "pr22_marker": _keyed("serology_row", "serology_id", "marker", canonical=ids.marker),
    "pr21_note_cell": _keyed("serology_row", "serology_id", "note", is_note=ids.is_note),
    "pr35_font_token": _keyed("part", "p_partkey", "concat('ABCDEF+', p_brand, '-Bold ', p_type)", token=ids.name_token),
}


def _ex(text: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"


def _try(x: str, kind: str = "DOUBLE") -> str:
    return f"try_cast({x} AS {kind})"


_E = r"([\d.]+)\s*\(\s*([\d.]+)\s*,\s*([\d.]+)\s*\)"
_E3 = [_try(_ex("t", _E, g)) for g in (1, 2, 3)]
_OK = f"({_E3[0]} IS NOT NULL AND {_E3[1]} IS NOT NULL AND {_E3[2]} IS NOT NULL)"
_I = r"([\d.]+)\s*[,，]\s*([\d.]+)"
_I2 = [_try(_ex("t", _I, g)) for g in (1, 2)]
_P = r"([0-9]+(?:\.[0-9]+)?)%\s*[（(]\s*([0-9]+(?:\.[0-9]+)?)%\s*[,，]\s*([0-9]+(?:\.[0-9]+)?)%\s*[)）]"
_T = _P.replace("%", "")
_ONE = r"([0-9]+(?:\.[0-9]+)?)"
_N = r"^\s*(\d+)\s*\(\s*([\d.]+)\s*\)"


def _of(source: str, keys: str, text: str, outputs: str) -> str:
    return f"WITH s AS (SELECT {keys}, {text} AS t FROM {source}) SELECT {keys}, {outputs} FROM s"


def _triple_of(g: int) -> str:
    return f"coalesce({_try(_ex('t', _P, g))}, {_try(_ex('t', _T, g))}, {_try(_ex('t', _ONE, 1))})"


_JOINED = r"regexp_replace(regexp_replace(regexp_replace(translate(trim(coalesce(t, '')), '—–_', '---'), '\s+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g')"
_ROOT, _FOLDER = "'https://site.org'", "'https://site.org/papers/'"
_LINK = r"""coalesce(nullif(regexp_extract(t, '(?i)href=["'']([^"'']+\.pdf(?:\?[^"'']*)?)["'']', 1), ''), nullif(regexp_extract(t, '(?i)src=["'']([^"'']+\.pdf(?:\?[^"'']*)?)["'']', 1), ''))"""
_HAN = "[一-鿿]"

SQL = {
    "pr1_estimate": _of("lineitem", _KEY, _ESTIMATE, f"CASE WHEN {_OK} THEN {_E3[0]} WHEN NOT regexp_matches(t, '{_E}') THEN {_try('trim(t)')} END AS mean, CASE WHEN {_OK} THEN {_E3[2]} END AS upper, CASE WHEN {_OK} THEN {_E3[1]} END AS lower"),
    "pr2_rate_percent": _of("lineitem", _KEY, _RATE, f"coalesce({_try(_ex('t', r'\(\s*([\d.]+)\s*\)', 1))}, {_try('trim(t)')}) AS rate"),
    "pr3_interval": _of("lineitem", _KEY, _ESTIMATE, f"CASE WHEN {_I2[1]} IS NOT NULL THEN {_I2[0]} END AS lower, CASE WHEN {_I2[0]} IS NOT NULL THEN {_I2[1]} END AS upper"),
    "pr4_triple": _of("lineitem", _KEY, _TRIPLE, f"{_triple_of(2)} AS lo, {_triple_of(1)} AS mid, {_triple_of(3)} AS up"),
    "pr5_count_and_share": _of("lineitem", _KEY, _COUNT, f"{_try(_ex('t', _N, 1), 'INT')} AS n, {_try(_ex('t', _N, 2))} / 100 AS share"),
    "pr6_event_count": _of("lineitem", _KEY, _COUNT, "CASE WHEN trim(t) IN ('', '-') THEN 0 ELSE cast(trunc(try_cast(trim(t) AS DOUBLE)) AS INT) END AS events"),
    "pr12_first_number": _of("lineitem", _KEY, _TRIPLE, f"{_try(_ex('t', r'([-+]?\d+(?:\.\d+)?)', 1))} AS value"),
    "pr13_series_scale": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * CASE WHEN l_orderkey % 7 = 0 THEN 100 WHEN l_partkey % 3 = 0 THEN 50 ELSE 1 END AS v FROM lineitem),
        s AS (SELECT l_partkey, avg(CASE WHEN v BETWEEN 0 AND 1 THEN 1 ELSE 0 END) >= 0.7 AS p FROM r GROUP BY 1)
        SELECT l_orderkey, l_linenumber, round(CASE WHEN p AND v > 1 THEN v / 100 ELSE v END, 6) AS scaled FROM r JOIN s USING (l_partkey)""",
    "pr14_tidy_number": _of("lineitem", _KEY, "l_extendedprice", "CASE WHEN t = floor(t) THEN cast(cast(t AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(printf('%.4f', t), '0'), '.') END AS shown"),
    "pr26_query_kind": _of("orders", "o_orderkey", _QUERY, r"CASE WHEN regexp_matches(t, '(?i)^(?:doi:\s*)?10\.\d{4,9}/\S+$') THEN 'doi' WHEN regexp_matches(t, '(?i)^(?:pmid:?\s*)?\d{6,9}$') THEN 'pmid' WHEN regexp_matches(t, '(?i)^https?://') THEN 'url' ELSE 'title' END AS kind"),
    "pr27_query_ids": _of("orders", "o_orderkey", _QUERY, rf"coalesce({_ex('t', r'(10\.\d{4,9}/[^\s?#]+)', 1)}, CASE WHEN regexp_matches(t, '^\.\d{{4,9}}/\S+$') THEN concat('10', t) END) AS doi, coalesce({_ex('t', r'(?i)pubmed[^\s]*?/(\d{6,9})', 1)}, {_ex('t', r'(?i)^\s*(?:pmid:?\s*)?(\d{6,9})\s*$', 1)}) AS pmid"),
    "pr25_url_risk": _of("orders", "o_orderkey", _URL, "CASE WHEN contains(lower(t), '<script') OR contains(lower(t), 'javascript:') THEN 'script' WHEN starts_with(lower(trim(t)), 'vbscript:') OR starts_with(lower(trim(t)), 'data:text/html') OR starts_with(lower(trim(t)), 'file:') THEN 'scheme' ELSE 'ok' END AS risk"),
    "pr29_first_pdf_link": _of("customer", "c_custkey", _HTML, rf"CASE WHEN regexp_matches({_LINK}, '^\w+://') THEN {_LINK} WHEN starts_with({_LINK}, '//') THEN concat('https:', {_LINK}) WHEN starts_with({_LINK}, '/') THEN concat({_ROOT}, {_LINK}) WHEN {_LINK} IS NOT NULL THEN concat({_FOLDER}, {_LINK}) END AS link"),
    "pr30_egress_risk": "SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'low' WHEN 2 THEN 'unknown' ELSE 'high' END AS risk FROM customer",
    "pr31_device_role": rf"""WITH s AS (SELECT c_custkey, {_IP} AS ip, c_custkey % 5 AS k, c_custkey % 3 AS m FROM customer),
        n AS (SELECT *, CASE WHEN NOT starts_with(ip, '300') THEN cast(split_part(ip, '.', 1) AS BIGINT) * 16777216 + cast(split_part(ip, '.', 2) AS BIGINT) * 65536 + cast(split_part(ip, '.', 3) AS BIGINT) * 256 + cast(split_part(ip, '.', 4) AS BIGINT) END AS ip_number FROM s)
        SELECT c_custkey, CASE WHEN ip = '10.168.0.0' THEN 'router' WHEN ip = '192.20.1.1' THEN 'this device' WHEN k = 0 THEN 'ssh host' WHEN k = 1 THEN 'printer' WHEN k = 2 THEN 'camera' WHEN k = 3 THEN 'web device' ELSE 'unknown' END AS role,
        starts_with(ip, '10.') OR starts_with(ip, '192.168.') OR starts_with(ip, '172.20.') AS private, m <> 1 AS unicast, ip_number FROM n""",
    "pr33_throughput": """WITH s AS (SELECT *, CASE WHEN l_linenumber = 1 THEN floor(l_extendedprice * 4096 / 1000) ELSE floor(l_extendedprice * 4096) END AS z FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 AND floor(l_extendedprice * 4096) > 0 THEN round_even(floor(l_extendedprice * 4096) * 8 / l_quantity / 1000000, 2) END AS mbps,
        CASE WHEN z < 1024 THEN concat(cast(z AS BIGINT), ' B') WHEN z < 1048576 THEN printf('%.1f KB', z / 1024.0) WHEN z < 1073741824 THEN printf('%.1f MB', z / 1048576.0) ELSE printf('%.1f GB', z / 1073741824.0) END AS size FROM s""",
    "pr34_link_fault": _of("orders", "o_orderkey", _URL, "CASE WHEN starts_with(t, 'file') THEN 'launches a program' WHEN starts_with(lower(trim(t)), 'javascript:') THEN 'script' WHEN regexp_matches(lower(trim(t)), '^https?://') THEN 'external address' ELSE 'unknown address' END AS fault"),
    "f1_squeeze": "SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x{3000}\\x{A0}\\x{2009}\\x{202F}\\x{2003}\\x0B\\x{85}\\x{2028}\\x{2029}]+', ' ', 'g'))) AS squeezed FROM documents",
    "f2_sample_id": f"""WITH s AS (SELECT o_orderkey, {_SAMPLE} AS t FROM orders), j AS (SELECT o_orderkey, {_JOINED} AS s FROM s),
        p AS (SELECT *, list_filter(string_split(s, '-'), lambda x: x <> '') AS w FROM j), q AS (SELECT *, translate(w[1], 'OoIl', '0011') AS a FROM p)
        SELECT o_orderkey, CASE WHEN len(w) >= 3 THEN concat(CASE WHEN regexp_full_match(a, '\\d+') AND length(a) < 3 THEN lpad(a, 3, '0') ELSE a END, '-', translate(upper(w[2]), 'OIL', '011'), '-', lower(w[3])) ELSE s END AS sample FROM q""",
    "f3_scanned_sample_id": f"""WITH s AS (SELECT o_orderkey, {_SAMPLE} AS t FROM orders), j AS (SELECT o_orderkey, {_JOINED} AS s FROM s), p AS (SELECT *, string_split(s, '-') AS w FROM j)
        SELECT o_orderkey, CASE WHEN len(w) >= 3 THEN concat(CASE WHEN regexp_matches(w[1], '\\d') THEN translate(w[1], 'Oo', '00') ELSE w[1] END, '-', regexp_replace(regexp_replace(w[2], '(?i)^M[Il]$', 'M1'), '(?i)^M[Il](\\d+)$', 'M1\\1'), '-', w[3]) ELSE s END AS sample FROM p""",
    "f20_series_key": "SELECT p_partkey, lower(p_brand) AS series FROM part",
    "f23_natural_key": r"""WITH s AS (SELECT c_custkey, lower(concat(c_mktsegment, ' ', c_custkey % 1000, '-', c_nationkey)) AS name FROM customer)
        SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(name, '\d+|\D+'), lambda r: CASE WHEN regexp_matches(r, '^\d') THEN lpad(r, 20, '0') ELSE r END), '') AS sort_key FROM s""",
    "f24_safe_name": r"""WITH s AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN ' / ' ELSE concat(p_name, ' / ', p_type, '?') END AS t FROM part)
        SELECT p_partkey, coalesce(nullif(left(regexp_replace(regexp_replace(trim(t), '[^\p{L}\p{N}._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 20), ''), 'report') AS file_name FROM s""",
    "f25_text_hash": "SELECT doc_id, md5(text) AS hash FROM documents",
    "f30_axis_bounds": """WITH s AS (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1)
        SELECT l_returnflag, greatest(floor((lo - (hi - lo) * 0.1::DOUBLE) / 500.0::DOUBLE) * 500, 0) AS axis_low, ceil((hi + (hi - lo) * 0.1::DOUBLE) / 500.0::DOUBLE) * 500 AS axis_high FROM s""",
    "f34_han_count": f"SELECT doc_id, len(regexp_extract_all(text, '{_HAN}')) AS han FROM documents",
    "f33_translated": r"SELECT doc_id, coalesce(trim(text) <> '' AND trim(text) <> 'source' AND regexp_matches(text, '[^\x00-\x7F]'), false) AS good FROM documents",
    "f35_masked": """WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'short' ELSE c_name END AS t FROM customer)
        SELECT c_custkey, CASE WHEN length(t) <= 8 THEN repeat('*', length(t)) ELSE concat(left(t, 4), repeat('*', length(t) - 8), right(t, 4)) END AS shown FROM s""",
    "f40_cell_range": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('Sheet ', p_size) WHEN 1 THEN 'Data' END AS sheet,
        CASE p_partkey % 3 WHEN 0 THEN least(p_size, p_size % 7 + 1) WHEN 1 THEN p_size END AS min_row, CASE p_partkey % 3 WHEN 0 THEN greatest(p_size, p_size % 7 + 1) WHEN 1 THEN p_size END AS max_row,
        CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS min_col, CASE p_partkey % 3 WHEN 0 THEN 27 WHEN 1 THEN 3 END AS max_col FROM part""",
    "f41_part_number": "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_size END AS part FROM part",
    "k2_cell_address": "SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN p_size END AS row, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 27 WHEN 2 THEN 16384 END AS col FROM part",
    "pr22_marker": """WITH s AS (SELECT serology_id, replace(lower(trim(marker)), ' ', '') AS m FROM serology_row)
        SELECT serology_id, CASE WHEN contains(m, 'anti-hbe') OR contains(m, 'antihbe') THEN 'Anti-HBe' WHEN contains(m, 'hbeag') THEN 'HBeAg' WHEN contains(m, 'hbsag') THEN 'HBsAg'
        WHEN contains(m, 'anti-hbc') OR contains(m, 'antihbc') THEN 'Anti-HBc' WHEN contains(m, 'anti-hbs') OR contains(m, 'antihbs') THEN 'Anti-HBs' END AS canonical FROM s""",
    "pr21_note_cell": f"""WITH s AS (SELECT serology_id, trim(coalesce(note, '')) AS t FROM serology_row)
        SELECT serology_id, t IN ('阴性', '阳性', '反应', '可疑', '待查') OR (length(t) <= 4 AND regexp_full_match(t, '{_HAN}+')) AS is_note FROM s""",
    "pr35_font_token": r"SELECT p_partkey, regexp_replace(lower(concat(p_brand, '-Bold ', p_type)), '[-\s_]+', '', 'g') AS token FROM part",
}
