"""Registered queries of the training-data operators, and the SQL of those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx.llm import bpe, canon, components, formatting, mixing, nearsets, residue, survivors
from calyx.runtime import table

#: Two slides are linked from this similarity on.
LINK = 0.6


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = components.match_edges(table(spark, sf_dir, "slide_match"), "global_id_a", "global_id_b", "similarity", LINK)
    return components.connected_components(edges).select(F.col("id").alias("global_id"), F.col("component").alias("cluster_id"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slide with its cluster; a slide without a link is its own."""
    return components.cluster_records(
        table(spark, sf_dir, "slide_info"), table(spark, sf_dir, "slide_match"),
        "global_id", "global_id_a", "global_id_b", "similarity", LINK,
    )


def _usable() -> dict[str, Column]:
    return {
        "decision": survivors.decision_value(F.col("decision")),
        "shape_count": survivors.shape_value(F.col("shape_count")),
        "notes_flags": survivors.flag_values(F.col("notes_flags")),
    }


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.preferred_rows(
        table(spark, sf_dir, "merge_report"), "global_id", "report_id", _usable(),
        "tool", table(spark, sf_dir, "report_tool"), "tool", "trust", "recorded_at",
    ).select("global_id", "field", "report_id")


def _truth(spark: SparkSession, sf_dir: str) -> survivors.Truth:
    usable = _usable()
    fields = {k: usable[k] if k == "notes_flags" else F.array_compact(F.array(usable[k])) for k in usable}
    reports = table(spark, sf_dir, "merge_report").select("global_id", "tool", "decision", "shape_count", "notes_flags")
    return survivors.latent_truth(survivors.claims_of(reports, "global_id", "tool", fields))


def p2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each slide's likeliest decision and shape count, and every flag judged true."""
    merged = survivors.merged_records(_truth(spark, sf_dir), ["decision", "shape_count"], ["notes_flags"])
    return merged.select(
        F.col("entity").alias("global_id"), "decision", F.col("shape_count").cast("int").alias("shape_count"), "notes_flags",
        F.round("decision_probability", 6).alias("decision_probability"),
        F.round("shape_count_probability", 6).alias("shape_count_probability"),
    )


def p2_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inferred sensitivity and specificity of every tool, by field."""
    return _truth(spark, sf_dir).sources


def _typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The typed values of both fields, and the reference list."""
    notes = table(spark, sf_dir, "serology_row").select(
        F.lit("note").alias("field"), F.col("serology_id").alias("row_id"), F.col("note").alias("value")
    )
    metrics = table(spark, sf_dir, "pzfx_table").select(
        F.lit("metric").alias("field"), F.col("pzfx_id").alias("row_id"), F.col("metric").alias("value")
    )
    return notes.unionByName(metrics), canon.reference_rows(table(spark, sf_dir, "canon_value"), "canon_id", "field", "label", "aliases")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, reference = _typed(spark, sf_dir)
    return canon.map_values(values, "field", "row_id", "value", reference).select("field", "row_id", "canon_id").distinct()


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that fit no entry, with the number of their rows."""
    values, reference = _typed(spark, sf_dir)
    mapped = canon.map_values(values, "field", "row_id", "value", reference).where("canon_id = 0")
    return mapped.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def p3_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries within reach of each different value, not only the best."""
    values, reference = _typed(spark, sf_dir)
    return canon.entries_within(values, "field", "value", reference)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.formatting_copies(table(spark, sf_dir, "pdf_file"), "file_id", "name", "page1_text")


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record, with the number of its copies and spellings."""
    return formatting.collapse_formatting(table(spark, sf_dir, "pdf_file"), "file_id", "name", "page1_text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nearsets.similar_pairs(table(spark, sf_dir, "slide_info"), "global_id", "text_content")
    return pairs.select(F.col("id_a").cast("int").alias("id_a"), F.col("id_b").cast("int").alias("id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per slide, whatever its text, its group of near-duplicates, and its highest similarity anew."""
    found = nearsets.groups_of_all(table(spark, sf_dir, "slide_info"), "global_id", "text_content")
    return found.select(
        F.col("id").cast("int").alias("global_id"), F.col("cluster_id").cast("int").alias("cluster_id"), "n_links",
        F.round("max_similarity", 9).alias("max_similarity"),
    )


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each text comes back from its ids, and how many there are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", bpe.encode_column(F.col("text")).alias("ids"))
    back = F.coalesce(F.col("text"), F.lit("")) == bpe.decode_column(F.col("ids"))
    return docs.select("doc_id", F.size("ids").alias("n_ids"), back.alias("same"))


def _mix(spark: SparkSession, sf_dir: str, by_entropy: bool = False) -> tuple[DataFrame, DataFrame]:
    target = table(spark, sf_dir, "mix_target")
    texts = mixing.mix_texts(
        table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", "source", "text", target, bpe.count_column(F.col("text"))
    )
    goal = mixing.target_rows(target, "source", "target_share", "max_repeats")
    return mixing.mix(texts, goal, target_entropy=mixing.entropy({k: v[0] for k, v in goal.items()}) if by_entropy else None)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn texts, and how often each is used."""
    return _mix(spark, sf_dir)[0].select(F.col("key").alias("doc_id"), "source", "tokens", "uses")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the share it was to have and the share it has."""
    return _mix(spark, sf_dir)[1].select(
        "source", "target_share", "max_repeats", "texts", "available_tokens", "exponent", "drawn_tokens", "actual_share", "most_uses"
    )


def p7_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix by temperature alone: the exponent at which the natural shares have the
    target's entropy, the weights it gives, and what is drawn by them."""
    return _mix(spark, sf_dir, by_entropy=True)[1].select(
        "source", "available_tokens", "max_repeats", "exponent", "weight", "drawn_tokens", "actual_share", "most_uses"
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.with_residue(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id").distinct()


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay once those with residue are left out."""
    return residue.without_residue(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "source", "n_chars")


_LINKED = f"""
    SELECT DISTINCT global_id_a AS a, global_id_b AS b FROM slide_match
    WHERE similarity >= {LINK} AND NOT isnan(similarity)
      AND global_id_a IS NOT NULL AND global_id_b IS NOT NULL AND global_id_a <> global_id_b"""
_REACH = f"""
    WITH RECURSIVE pair AS ({_LINKED}), edge AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
    reach AS (SELECT a AS id, a AS other FROM edge UNION SELECT r.id, e.b FROM reach r JOIN edge e ON r.other = e.a),
    cluster AS (SELECT id, min(other) AS cluster_id FROM reach GROUP BY id)"""

SQL = {
    "p1_found": f"{_REACH} SELECT id AS global_id, cluster_id FROM cluster",
    "p1_clusters": f"""{_REACH} SELECT DISTINCT s.global_id, coalesce(c.cluster_id, s.global_id) AS cluster_id
        FROM slide_info s LEFT JOIN cluster c ON s.global_id = c.id WHERE s.global_id IS NOT NULL""",
}

#: The blanks that a decision may be written with are white space, hyphens and underscores.
_DECISION = r"replace(replace(replace(lower(regexp_replace(decision, '[\s\x{A0}\x{3000}]', '', 'g')), '-', ''), '_', ''), chr(8211), '')"
SQL["p2_found"] = f"""
    WITH r AS (
      SELECT m.*, t.trust FROM merge_report m
      LEFT JOIN (SELECT tool, min(trust) AS trust FROM report_tool GROUP BY tool) t ON m.tool = t.tool
      WHERE global_id IS NOT NULL AND report_id IS NOT NULL),
    many AS (SELECT global_id FROM r GROUP BY 1 HAVING count(DISTINCT report_id) > 1),
    usable AS (
      SELECT global_id, report_id, trust, recorded_at, 'decision' AS field FROM r
        WHERE {_DECISION} IN ('keepunique', 'keeppartialoverlap', 'dropconflict')
      UNION ALL SELECT global_id, report_id, trust, recorded_at, 'shape_count' FROM r WHERE shape_count > 0
      UNION ALL SELECT global_id, report_id, trust, recorded_at, 'notes_flags' FROM r
        WHERE len(list_filter(notes_flags, lambda f: regexp_matches(f, '[\\p{{L}}\\p{{Nd}}]'))) > 0),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY global_id, field
        ORDER BY trust ASC NULLS LAST, recorded_at DESC NULLS LAST, report_id DESC) AS rn FROM usable)
    SELECT global_id, field, report_id FROM ranked WHERE rn = 1 AND global_id IN (SELECT global_id FROM many)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        p1_found, p1_clusters, p2_found, p2_survivors, p2_sources, p3_found, p3_unmatched, p3_candidates, p4_found, p4_records,
        p5_found, p5_groups, p6_ids, p6_roundtrip, p7_mix, p7_report, p7_temperature, p8_found, p8_clean,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
