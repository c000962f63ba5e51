"""Queries over file listings, first pages and duplicate reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyx.operators import duplicates
from calyx.runtime import table


def dup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & (F.col("text") != ""))
    return duplicates.duplicate_members(docs, "doc_id", F.md5("text")).select("doc_id", "first_id", "copies")


QUERIES = {"dup_exact": dup_exact}
SQL = {
    "dup_exact": """
        WITH d AS (SELECT doc_id, md5(text) AS k FROM documents WHERE text IS NOT NULL AND text <> ''),
        g AS (SELECT k, min(doc_id) AS first_id, count(*) AS copies FROM d GROUP BY k HAVING count(*) > 1)
        SELECT d.doc_id, g.first_id, g.copies FROM d JOIN g USING (k)""",
}
