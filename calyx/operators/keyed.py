"""Aggregations by key: latest, best, merged, counted with zeros, ranked.

All of them are plain aggregations, which combine map-side, so a key that holds a
third of the rows costs no more than its partial results. Windows are used only
where ranks within a key are the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calyx.functions.texts import quoted


def filled(value: Column) -> Column:
    """The trimmed value; null if nothing is left."""
    plain = F.trim(value)
    return F.when(plain != "", plain)


def best_row(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Per key the columns of the row with the greatest order; give a last order column that is unique."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), rank).alias("_best"))
    return best.select(*keys, "_best.*")


def merged_fields(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[str], prefer_last: bool = True) -> DataFrame:
    """Per key and field the last (or first) value that is not empty, each field by itself."""
    rank = F.struct(*order)
    pick = F.max_by if prefer_last else F.min_by
    out = []
    for f in fields:
        value = filled(F.col(f))
        out.append(pick(value, F.when(value.isNotNull(), rank)).alias(f))
    return rows.groupBy(*keys).agg(*out, F.min(rank).alias("_first")).withColumn("first_seen", F.col(f"_first.{order[0]}")).drop("_first")


def counts_with_zeros(rows: DataFrame, value: str, levels: DataFrame, level: str, name: str = "n") -> DataFrame:
    """The number of rows of each level, also of those without any; other values are left out."""
    counted = rows.groupBy(F.col(value).alias(level)).agg(F.count(F.lit(1)).alias(name))
    return levels.join(counted, level, "left").na.fill(0, [name])


def top_ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The k first rows per key, with their rank.

    A rank limit lets Spark keep only k rows per key and task before the shuffle.
    """
    ranked = rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= k)


def keyword_score(text: Column, weights: dict[str, int], boundary: str = "[^a-zA-Z0-9]") -> Column:
    """Sum of weight times hits; a hit needs a character after the keyword that is no letter or digit."""
    score = F.lit(0)
    for word, weight in weights.items():
        score = score + F.regexp_count(text, F.lit(quoted(word) + boundary)) * weight
    return score


def risk_level(score: Column, valid: Column) -> Column:
    return F.when(~valid, "UNKNOWN").when(score == 0, "LOW").when(score <= 4, "MEDIUM").otherwise("HIGH")


def frequent_items(rows: DataFrame, item: str, place: str, least: int) -> DataFrame:
    """Items seen in at least so many different places.

    Two aggregations instead of a distinct count, so that an item seen everywhere
    is spread over its places first.
    """
    return rows.groupBy(item, place).agg(F.lit(1).alias("_one")).groupBy(item).agg(F.count("_one").alias("places")).where(F.col("places") >= least)


def decisions(pairs: DataFrame, size: DataFrame, low: float, high: float) -> DataFrame:
    """``id, decision`` of all ids of ``size(id, shapes)`` from ``pairs(a, b, similarity)``, a < b.

    At ``high`` or more the one with fewer shapes is dropped (the later one if equal);
    from ``low`` on both are partial unless dropped; all others are unique.
    """
    near = pairs.where(F.col("similarity") >= low)
    a, b = size.select(F.col("id").alias("a"), F.col("shapes").alias("sa")), size.select(F.col("id").alias("b"), F.col("shapes").alias("sb"))
    loser = near.where(F.col("similarity") >= high).join(a, "a").join(b, "b").select(F.when(F.col("sa") < F.col("sb"), F.col("a")).otherwise(F.col("b")).alias("id"))
    marks = loser.select("id", F.lit(2).alias("mark")).unionByName(near.select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).alias("mark")))
    worst = marks.groupBy("id").agg(F.max("mark").alias("mark"))
    return size.join(worst, "id", "left").select(
        "id", F.when(F.col("mark") == 2, "drop_conflict").when(F.col("mark") == 1, "keep_partial_overlap").otherwise("keep_unique").alias("decision")
    )


def prefix_totals(files: DataFrame, path: str, size: str, changed: str) -> DataFrame:
    """Size, files and latest change of every folder, each file counted in all folders above it."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    spread = files.where(F.size(F.split(path, "/")) > 1).select(F.explode(prefixes).alias("folder"), size, changed)
    return spread.groupBy("folder").agg(F.sum(size).alias("total_size"), F.count(F.lit(1)).alias("files"), F.max(changed).alias("latest"))


def top_overall(rows: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return rows.orderBy(*order).limit(k)

