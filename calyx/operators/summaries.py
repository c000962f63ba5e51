"""Counts and verdicts over groups: aggregations that combine map-side, one shuffle each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_groups(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Groups with two or more different keys, with their number and the smallest. A null group is none."""
    counted = rows.where(F.col(group).isNotNull()).select(group, key).distinct().groupBy(group)
    return counted.agg(F.count(F.lit(1)).alias("files"), F.min(key).alias("first_id")).where("files > 1")


def complete_per_group(rows: DataFrame, group: str, key: str, required: Sequence[str]) -> DataFrame:
    """Different keys per group whose required columns all have a value."""
    whole = F.col(group).isNotNull()
    for name in required:
        whole = whole & F.col(name).isNotNull()
    return rows.where(whole).select(group, key).distinct().groupBy(group).agg(F.count(key).alias("complete"))


def status_totals(rows: DataFrame, group: str, status: str, names: Mapping[str, str], amount: str, digits: int = 2) -> DataFrame:
    """One column per status with its rows, and the total amount."""
    counts = [F.count_if(F.col(status) == value).alias(name) for name, value in names.items()]
    return rows.groupBy(group).agg(*counts, F.round(F.sum(amount), digits).alias("total"))


def best_and_mean(rows: DataFrame, group: str, key: str, value: str, even: float = 0.85, mixed: float = 0.4) -> DataFrame:
    """The best key of each group, its value, the mean, and how near the mean comes to the best.

    Null values are left out; of equal values the smaller key wins.
    """
    best = rows.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.max_by(key, F.struct(value, -F.col(key))).alias("best_id"), F.max(value).alias("best"), F.avg(value).alias("mean")
    )
    ratio = F.col("mean") / F.col("best")
    return best.withColumn("verdict", F.when(ratio >= even, "even").when(ratio >= mixed, "mixed").otherwise("uneven"))


def routed_by_hits(rows: DataFrame, doc: str, page: str, hit: Column, first_pages: int, least: int = 1) -> DataFrame:
    """``vector`` for documents of whose first pages at least so many hit, else ``scan``; of later pages nothing is read."""
    hits = rows.where(F.col(page) <= first_pages).groupBy(doc).agg(F.count_distinct(F.when(hit, F.col(page))).alias("hits"))
    return hits.select(doc, F.when(F.col("hits") >= least, "vector").otherwise("scan").alias("route"))


def anomaly_totals(rows: DataFrame, doc: str, page: str, bad: Column) -> DataFrame:
    """Pages and bad pages of each document, and which they are; a document's pages are few."""
    return rows.groupBy(doc).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(bad).alias("distorted"),
        F.array_join(F.sort_array(F.collect_list(F.when(bad, F.col(page)))), ",").alias("bad_pages"),
    )


def best_match_per_key(keys: DataFrame, key: str, pairs: DataFrame, a: str = "a", b: str = "b", similarity: str = "similarity") -> DataFrame:
    """Every different key with its highest similarity in any pair; 0 without one."""
    each = pairs.select(F.explode(F.array(a, b)).alias(key), similarity).groupBy(key).agg(F.max(similarity).alias("_best"))
    return keys.select(key).distinct().join(each, key, "left").select(key, F.coalesce("_best", F.lit(0.0)).alias("max_similarity"))


def distinct_series(rows: DataFrame, columns: Sequence[str], kept: Column | None = None) -> DataFrame:
    """The different combinations of the columns, of the rows that are kept."""
    return (rows if kept is None else rows.where(kept)).select(*columns).distinct()


def reasons_per_group(rows: DataFrame, group: str, reason: str, file: Sequence[str]) -> DataFrame:
    """The different reasons of a group, of a short list, and its number of different files."""
    return rows.groupBy(group).agg(
        F.array_join(F.sort_array(F.collect_set(reason)), ",").alias("reasons"), F.count_distinct(*file).alias("unique_files")
    )


def rule_hits(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """How many rows each rule hits; rules without a hit are absent. A row may hit several."""
    hits = F.array_compact(F.array(*[F.when(rule, F.lit(message)) for message, rule in rules.items()]))
    return rows.select(F.explode(hits).alias("message")).groupBy("message").agg(F.count(F.lit(1)).alias("hits"))


def part_statistics(rows: DataFrame, part: str, fills: str, changed: Column) -> DataFrame:
    """What was filled in and how many rows changed, per part of a document."""
    return rows.groupBy(part).agg(F.sum(fills).alias("fills"), F.sum(F.when(changed, 1).otherwise(0)).alias("changed"))


def reduction(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Rows before and different keys after de-duplication, and the percentage saved; null of nothing."""
    counted = rows.groupBy(group).agg(F.count(F.lit(1)).alias("before"), F.count_distinct(key).alias("after"))
    saved = F.when(F.col("before") > 0, 100.0 * (F.col("before") - F.col("after")) / F.col("before"))
    return counted.select(group, "before", "after", F.round(saved, 4).alias("reduction"))


def readable_files(rows: DataFrame, folder: str, error: str, text: str) -> DataFrame:
    """Files that were read and that were skipped, and the characters read; a null text has none."""
    fine = F.col(error).isNull()
    return rows.groupBy(folder).agg(
        F.count_if(fine).alias("added"), F.count_if(~fine).alias("skipped"),
        F.sum(F.when(fine, F.coalesce(F.length(text), F.lit(0))).otherwise(0)).alias("chars"),
    )


def channel_median(rows: DataFrame, channel: str, value: str) -> DataFrame:
    """The exact median per channel: counts of different values combine map-side."""
    return rows.groupBy(channel).agg(F.round(F.percentile(value, 0.5), 4).alias("median"))


def first_by(rows: DataFrame, keys: Sequence[str], wanted: Column, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per key the first wanted row in order, else the first of all; by aggregation, so a hot key is no window."""
    rank = F.struct((~F.coalesce(wanted, F.lit(False))).alias("_no"), *order)
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*fields), rank).alias("_r")).select(*keys, "_r.*")


def selected_first(rows: DataFrame, key: str, selected: Column, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Of the candidates of a key the one selected by hand, else the first in order."""
    return first_by(rows, [key], selected, order, fields)


def table_near_keyword(tables: DataFrame, doc: str, holds: Column, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per document the first table that holds the keyword, else the first of its matching pages."""
    return first_by(tables, [doc], holds, order, fields)


def rule_engine(documents: DataFrame, doc: str, text: str, rules: DataFrame, words: Sequence[tuple[int, str]]) -> DataFrame:
    """Each rule ``ord`` with the first document that holds its keyword, and whether one does.

    ``words`` are the rules' keywords, a short list, looked for in one pass.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    hits = F.array_compact(F.array(*[F.when(body.contains(word), F.lit(n)) for n, word in words]))
    first = documents.select(F.col(doc), F.explode(hits).alias("ord")).groupBy("ord").agg(F.min(doc).alias(doc))
    return rules.join(first, "ord", "left").withColumn("status", F.when(F.col(doc).isNotNull(), "ok").otherwise("not found"))
