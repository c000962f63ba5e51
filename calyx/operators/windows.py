"""Order-dependent operators as window expressions.

Every operator takes the columns that partition and order its rows. A window sorts
one partition in one task and spills; give it keys whose groups are documents,
tables or users, not a key that may hold a third of all rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from calyx import runtime


def _over(partition: Sequence[str], order: Sequence):
    return W.partitionBy(*partition).orderBy(*order)


def forward_filled(value: Column, partition: Sequence[str], order: Sequence, default=None) -> Column:
    """The last value that is not null, up to and with this row."""
    w = _over(partition, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.last(value, ignorenulls=True).over(w)
    return last if default is None else F.coalesce(last, F.lit(default))


def span_end(position: Column, partition: Sequence[str], order: Sequence, width: Column) -> Column:
    """Where a column group ends: the start of the next one, else the width."""
    return F.coalesce(F.lead(position).over(_over(partition, order)), width)


def islands(rows: DataFrame, partition: Sequence[str], start: str, end: str, order: Sequence[str]) -> DataFrame:
    """Overlapping or touching spans merged: an island number per row.

    A span opens a new island if it starts after the greatest end before it.
    """
    w = _over(partition, [start, *order])
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    marked = rows.withColumn("_opens", opens)
    return marked.withColumn("island", F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_opens")


def within_next(rows: DataFrame, partition: Sequence[str], order: Sequence, is_title: Column, hit: Column, value: Column, reach: int, last: bool) -> DataFrame:
    """For each title row the value of the last (or first) hit among the next ``reach`` rows."""
    w = _over(partition, order).rowsBetween(1, reach)
    seen = F.when(hit, value)
    pick = F.last(seen, ignorenulls=True) if last else F.first(seen, ignorenulls=True)
    return rows.withColumn("found", pick.over(w)).where(is_title)


def running_offset(length: Column, partition: Sequence[str], order: Sequence) -> Column:
    """Where a run of text starts in the joined text."""
    w = _over(partition, order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(length).over(w), F.lit(0))


def repaired_pages(page: Column, pages: Column, partition: Sequence[str], order: Sequence) -> Column:
    """Invalid page numbers take the last good one (1 at first); none lies beyond the end."""
    good = F.when(page >= 1, page)
    return F.least(forward_filled(good, partition, order, 1), pages)


def without_repeats(rows: DataFrame, title: str, partition: Sequence[str], order: Sequence) -> DataFrame:
    """Rows whose title equals that of the row before are dropped."""
    first = F.row_number().over(_over(partition, order)) == 1
    return rows.withColumn("_keep", first | ~F.lag(title).over(_over(partition, order)).eqNullSafe(F.col(title))).where("_keep").drop("_keep")


def first_appearance_index(rows: DataFrame, value: str, order: str) -> DataFrame:
    """``value, index``: 0 for the value that appears first, and so on; values are categories, few."""
    seen = rows.groupBy(value).agg(F.min(order).alias("_first"))
    return runtime.numbered_within(seen, [], ["_first", value], "_n").select(value, (F.col("_n") - 1).cast("int").alias("index"))


def numbered_names(rows: DataFrame, name: str, order: Sequence[str], style: str = "_{n}") -> DataFrame:
    """Repeated names get a suffix from the second on: ``_1``, ``_2``; style ``（{n}）`` counts from 2.

    A name that a third of the rows share is numbered in parts, not in one task.
    """
    before, after = style.split("{n}")
    shown = F.col("_n") if before == "（" else F.col("_n") - 1
    named = F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(before), shown.cast("string"), F.lit(after)))
    return runtime.numbered_within(rows, [name], order, "_n").withColumn(name, named).drop("_n")


def marker_groups(header: DataFrame, row: Sequence[str], col: str, text: str, markers: Mapping[str, str], width: Column) -> DataFrame:
    """Column groups of a header row: from each cell that names a marker up to the next one, or the table's width.

    ``markers``: spellings, of any case and without white space, and the marker they name.
    Gives the row's key, ``marker, first, until`` (until is not included).
    """
    spelled = F.lower(F.regexp_replace(text, r"(?U)\s+", ""))
    names = F.create_map(*[F.lit(x) for pair in markers.items() for x in (pair[0].lower(), pair[1])])
    starts = header.withColumn("marker", F.try_element_at(names, spelled)).where("marker is not null")
    return starts.select(*row, "marker", F.col(col).alias("first"), span_end(F.col(col), row, [col], width).alias("until"))


def with_dividers(rows: DataFrame, partition: Sequence[str], order: Sequence[str], chapter: str) -> DataFrame:
    """Rows and a divider row before each change of chapter, with the final index that counts both."""
    w = _over(partition, order)
    changed = F.when(F.lag(chapter).over(w).eqNullSafe(F.col(chapter)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("original", F.row_number().over(w)).withColumn("_new", changed)
    counted = marked.withColumn("_dividers", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    counted = counted.withColumn("final", F.col("original") + F.col("_dividers"))
    dividers = counted.where("_new = 1").withColumn("final", F.col("final") - 1).withColumn("kind", F.lit("divider")).withColumn("original", F.lit(None).cast("int"))
    return counted.withColumn("kind", F.lit("row")).unionByName(dividers).drop("_new", "_dividers")


def capped(rows: DataFrame, partition: Sequence[str], must_keep: Column, order: Sequence, limit: int) -> DataFrame:
    """At most ``limit`` rows, those that must stay first; all of them stay even beyond the limit.

    Of the others no task sends more than ``limit`` of a partition.
    """
    must = F.coalesce(must_keep, F.lit(False))
    kept = rows.where(must)
    counted = kept.groupBy(*[F.col(p).alias(f"_{p}") for p in partition]).agg(F.count(F.lit(1)).alias("_kept"))
    same = F.lit(True)
    for p in partition:
        same = same & F.col(p).eqNullSafe(F.col(f"_{p}"))
    few = rows.where(~must).withColumn("_rank", F.row_number().over(W.partitionBy(*partition).orderBy(*order))).where(F.col("_rank") <= limit)
    room = few.join(counted, same, "left").where(F.col("_rank") <= limit - F.coalesce("_kept", F.lit(0)))
    return kept.unionByName(room.select(*rows.columns))


def tie_break(candidates: DataFrame, slot: str, mode: str) -> DataFrame:
    """One candidate per slot, by the slot's mode; within a mode the first in order wins.

    Modes: first, max_shape_count, body contains N=64, body contains N=32,
    has_table, max_text_len. A mode without a hit falls back to the first.
    """
    key = (
        F.when(F.col(mode) == "max_shape_count", -F.coalesce("shape_count", F.lit(0)))
        .when(F.col(mode).isin("N=64", "N=32"), F.when(F.col("text").contains(F.col(mode)), 0).otherwise(1))
        .when(F.col(mode) == "has_table", F.when(F.col("has_table"), 0).otherwise(1))
        .when(F.col(mode) == "max_text_len", -F.coalesce(F.length("text"), F.lit(0))).otherwise(0)
    )
    return candidates.withColumn("_rank", F.row_number().over(W.partitionBy(slot).orderBy(key, "ord"))).where("_rank = 1").drop("_rank")
