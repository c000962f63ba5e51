"""Joins that reconcile, backfill, audit, look up and compare.

Equi joins are left to Catalyst: a side is broadcast only behind ``runtime.small``,
which counts it first. Range joins become equi joins on grid cells. Similarity
joins go through an inverted index, never through a product of both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calyx import runtime
from calyx.functions.numbers import close
from calyx.operators.keyed import filled


def complete_match(left: DataFrame, right: DataFrame, keys: Sequence[str], needed: Sequence[str]) -> DataFrame:
    """Inner join of rows that are complete on both sides; the right side's columns get a prefix.

    A key that repeats on a side counts with its last row; give both sides an ``ord``.
    """
    def last(rows: DataFrame) -> DataFrame:
        cols = [c for c in rows.columns if c not in keys]
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("ord")).alias("_r")).select(*keys, "_r.*").drop("ord")
        return best.dropna(subset=list(needed))

    target = last(right)
    named = target.select(*keys, *[F.col(c).alias(f"target_{c}") for c in target.columns if c not in keys])
    return last(left).join(named, list(keys))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer comparison: ``side`` is left, right, differs or same. Two nulls are the same."""
    a = left.select(*keys, *[F.col(v).alias(f"left_{v}") for v in values], F.lit(True).alias("_l"))
    b = right.select(*keys, *[F.col(v).alias(f"right_{v}") for v in values], F.lit(True).alias("_r"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"left_{v}").eqNullSafe(F.col(f"right_{v}"))
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").when(same, "same").otherwise("differs")
    return a.join(b, list(keys), "full").withColumn("side", side).drop("_l", "_r")


def backfill(rows: DataFrame, reference: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of which every value is empty take all values of the reference together; ``filled`` marks them."""
    ref = reference.select(*keys, *[F.coalesce(filled(F.col(v)), F.lit("")).alias(f"ref_{v}") for v in values])
    empty = F.lit(True)
    offered = F.lit(False)
    for v in values:
        empty = empty & filled(F.col(v)).isNull()
        offered = offered | (F.col(f"ref_{v}") != "")
    take = F.coalesce(empty & offered, F.lit(False))
    joined = rows.join(ref, list(keys), "left").withColumn("filled", take)
    for v in values:
        joined = joined.withColumn(v, F.when(F.col("filled"), F.col(f"ref_{v}")).otherwise(F.col(v)))
    return joined.drop(*[f"ref_{v}" for v in values])


def through_alias(rows: DataFrame, term: str, aliases: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Inner join through a synonym table ``alias, canonical``; a term without synonym stands for itself."""
    named = rows.join(runtime.small(aliases), F.col(term) == F.col("alias"), "left")
    return named.withColumn(key, F.coalesce("canonical", term)).drop("alias", "canonical").join(target, key)


def audit(actual: DataFrame, expected: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """``action``: FIX where the expected value differs beyond the tolerance, SKIP where nothing is expected, else OK."""
    want = expected.select(*keys, F.col(value).alias("expected"))
    joined = actual.select(*keys, F.col(value).alias("actual")).join(want, list(keys), "left")
    action = F.when(F.col("expected").isNull(), "SKIP").when(close(F.col("actual"), F.col("expected"), tolerance), "OK").otherwise("FIX")
    return joined.withColumn("action", action)


def duplicates_by(files: DataFrame, key: str, group: Column, reason: str) -> DataFrame:
    """``first, other, reason`` for every member of a group but its first; groups are not expanded into pairs."""
    keyed = files.select(F.col(key).alias("other"), group.alias("_group")).where("_group is not null").distinct()
    led = runtime.attach_group(keyed, ["_group"], [F.min("other").alias("first")])
    return led.where("first != other").select("first", "other", F.lit(reason).alias("reason"))


def _grams(words: str, n: int) -> Column:
    starts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: i + (n - 1) <= F.size(words))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def tfidf_pairs(docs: DataFrame, key: str, text: str, max_terms: int | None = 5000, ngrams: int = 2) -> DataFrame:
    """Cosine similarity of all pairs of documents that share a term, ``a < b``.

    Terms are one- and two-grams of lower-case words of two or more letters; the
    vocabulary is cut to the ``max_terms`` terms with most occurrences (ties by term),
    with None it is whole; idf is
    ln((1 + n) / (1 + df)) + 1 and rows are normalised. The pairs come from a
    self-join on terms; give it documents whose terms are selective, or few.
    """
    words = docs.select(F.col(key).alias("id"), F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)).alias("w"))
    grams = [F.col("w"), *[_grams("w", n) for n in range(2, ngrams + 1)]]
    terms = words.where(F.size("w") > 0).select("id", F.explode(F.concat(*grams)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = terms.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    if max_terms is not None:
        vocabulary = vocabulary.orderBy(F.desc("total"), "term").limit(max_terms)
    n = docs.agg(F.count_distinct(key)).first()[0]
    weighed = terms.join(runtime.small(vocabulary), "term").select("id", "term", (F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1)).alias("w"))
    norms = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weighed.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))
    other = unit.withColumnsRenamed({"id": "b", "w": "wb"})
    return unit.withColumnsRenamed({"id": "a", "w": "wa"}).join(other, "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))


def not_overlapping(items: DataFrame, boxes: DataFrame, place: Sequence[str], cell: float) -> DataFrame:
    """Items whose box meets no excluded box of the same place; touching counts as meeting.

    Boxes have ``x0, top, x1, bottom``. Both sides are put on a grid of ``cell``, so
    that the overlap test is an equi join on place and cell; items need an ``item``.
    """
    def spread(rows: DataFrame) -> DataFrame:
        lo, hi = (lambda c: F.floor(F.col(c) / cell).cast("int")), (lambda c: F.floor(F.col(c) / cell).cast("int"))
        return rows.withColumn("_gx", F.explode(F.sequence(lo("x0"), hi("x1")))).withColumn("_gy", F.explode(F.sequence(lo("top"), hi("bottom"))))

    names = {c: f"b_{c}" for c in ("x0", "top", "x1", "bottom")}
    other = spread(boxes.select(*place, "x0", "top", "x1", "bottom")).withColumnsRenamed(names)
    met = spread(items).join(other, [*place, "_gx", "_gy"]).where("x0 <= b_x1 and x1 >= b_x0 and top <= b_bottom and bottom >= b_top")
    return items.join(met.select("item").distinct(), "item", "left_anti")


def looked_back(rows: DataFrame, partition: Sequence[str], order: Sequence[str], tag: Column, steps: int, name: str) -> DataFrame:
    """The tag of the nearest of the last ``steps`` rows that has one."""
    w = W.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("_tag", tag).withColumn(name, F.coalesce(*[F.lag("_tag", i).over(w) for i in range(1, steps + 1)])).drop("_tag")


def zipped(left: DataFrame, right: DataFrame, partition: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows side by side by position within a partition, which may hold most rows; the longer side is cut.

    With the partition the order is unique.
    """
    a = runtime.numbered_within(left, partition, left_order, "_at")
    b = runtime.numbered_within(right, partition, right_order, "_at")
    return a.join(b, [*partition, "_at"]).withColumnRenamed("_at", "position")


def lookup_with_fallback(rows: DataFrame, key: str, exact: DataFrame, all_values: DataFrame, order: Sequence[str], value: str) -> DataFrame:
    """The value of the exact table, else the first of all tables; only misses reach the second join."""
    first = exact.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias("_exact"))
    hits = rows.join(first, key, "left")
    rest = all_values.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias("_any"))
    missed = hits.where("_exact is null").drop("_exact").join(rest, key, "left").withColumn("found", F.col("_any")).withColumn("how", F.when(F.col("_any").isNotNull(), "fallback").otherwise("none")).drop("_any")
    done = hits.where("_exact is not null").withColumn("found", F.col("_exact")).withColumn("how", F.lit("exact")).drop("_exact")
    return done.unionByName(missed)


def in_networks(addresses: DataFrame, ip: Column, networks: DataFrame) -> DataFrame:
    """Addresses with the narrowest network ``base, prefix`` they lie in: an equi join per prefix length.

    The prefix lengths in use are few (at most 33); they are collected.
    """
    lengths = [r[0] for r in networks.select("prefix").distinct().limit(34).collect()]
    base = addresses.withColumn("_ip", ip)
    spread = base.select("*", F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), (F.floor(F.col("_ip") / (2 ** (32 - p))) * (2 ** (32 - p))).cast("long").alias("base")) for p in lengths])).alias("_n")).select(*base.columns, "_n.*") if lengths else None
    if spread is None:
        return base.drop("_ip").withColumn("network", F.lit(None).cast("long"))
    hit = spread.join(networks, ["base", "prefix"]).groupBy(*addresses.columns).agg(F.max_by("base", "prefix").alias("network"), F.max("prefix").alias("prefix"))
    return hit
