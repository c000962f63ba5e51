"""Sets, listings and trees: what is in one table and not in another, and paths as folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calyx import runtime


def union_of(frames: Sequence[DataFrame]) -> DataFrame:
    """The different rows of all tables, by position of the columns."""
    return reduce(DataFrame.union, frames).distinct()


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """The different rows of both tables with the ``side`` they are on: both, left or right."""
    parts = (left.intersect(right), "both"), (left.subtract(right), "left"), (right.subtract(left), "right")
    return reduce(DataFrame.unionByName, [df.withColumn("side", F.lit(side)) for df, side in parts])


def undeclared(used: DataFrame, key: str, *declared: DataFrame) -> DataFrame:
    """The different keys in use that no table declares; a small table is broadcast."""
    return reduce(lambda rest, known: rest.join(runtime.small(known.select(key)), key, "left_anti"), declared, used.select(key).distinct())


def usage(declared: DataFrame, used: DataFrame) -> DataFrame:
    """Declared rows by ``kind``: used or unused."""
    return declared.subtract(used).withColumn("kind", F.lit("unused")).unionByName(declared.intersect(used).withColumn("kind", F.lit("used")))


def concatenated(tables: Mapping[str, DataFrame], name: str = "origin") -> DataFrame:
    """All rows of tables with the same columns, repeats included, with the table they come from."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(origin).alias(name), "*") for origin, df in tables.items()])


def kept_and_removed(rows: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows with their ``state``: kept if the key is used, else removed. A null key is removed."""
    keys = used.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_used", F.lit(True))
    return rows.join(keys, key, "left").withColumn("state", F.when(F.col("_used"), "kept").otherwise("removed")).drop("_used")


def not_registered(rows: DataFrame, registered: DataFrame, key: str, excluded: Column) -> DataFrame:
    """Rows whose key is not registered and that are not excluded; null counts as not excluded."""
    return rows.where(~F.coalesce(excluded, F.lit(False))).join(runtime.small(registered.select(key).distinct()), key, "left_anti")


def inherited(rows: DataFrame, key: str, link: str, value: str) -> DataFrame:
    """Each row with the value of the row it is linked to, where it is linked and that has one, else its own."""
    other = rows.select(F.col(key).alias(link), F.col(value).alias("_other")).dropDuplicates([link])
    return rows.join(other, link, "left").withColumn(value, F.coalesce("_other", value)).drop("_other")


def marked_as_in(rows: DataFrame, final: DataFrame, key: str, name: str, yes: str = "yes", no: str = "no") -> DataFrame:
    """The different keys, with whether the other table has them."""
    hit = final.select(key).distinct().withColumn("_hit", F.lit(True))
    return rows.select(key).distinct().join(hit, key, "left").select(key, F.when(F.col("_hit"), yes).otherwise(no).alias(name))


def stale_outputs(sources: DataFrame, outputs: DataFrame, key: str, changed: str, made: str) -> DataFrame:
    """Sources without an output, or whose first output is older than the source."""
    first = outputs.groupBy(key).agg(F.min(made).alias("_made"))
    return sources.join(first, key, "left").where(F.col("_made").isNull() | (F.col("_made") < F.col(changed))).drop("_made")


def requested(known: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """What was asked for, ``selected`` if it is known and else ``missing``."""
    wanted = asked.select(key).distinct()
    found = known.select(key).distinct().withColumn("_known", F.lit(True))
    return wanted.join(found, key, "left").select(key, F.when(F.col("_known"), "selected").otherwise("missing").alias("state"))


def subsets(rows: DataFrame, conditions: Mapping[str, Column], name: str = "report") -> DataFrame:
    """Rows once for each subset whose condition they meet, by one scan."""
    hit = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
    return rows.withColumn(name, F.explode(hit))


def reordered(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Wanted columns that exist first, then the others in their order."""
    return df.select(*[c for c in wanted if c in df.columns], *[c for c in df.columns if c not in wanted])


def sheets(tables: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Tables of a report below each other, with their ``sheet``, columns by position and as text."""
    parts = [df.select(*[F.col(c).cast("string").alias(n) for c, n in zip(df.columns, columns)]) for df in tables.values()]
    return concatenated(dict(zip(tables, parts)), "sheet")


def json_rows(rows: DataFrame, columns: Sequence[str], name: str = "json") -> DataFrame:
    """Rows with the columns as one JSON text, in the order given; null fields are left out."""
    return rows.withColumn(name, F.to_json(F.struct(*columns)))


def without_strip(rows: DataFrame, is_text: Column, left: Column, width: float, strip_from: float) -> DataFrame:
    """Rows that are no text, and texts that end before the excluded strip at the right."""
    return rows.where(~is_text | (left + width < strip_from))


def covering_pictures(pictures: DataFrame, elements: DataFrame, place: Sequence[str], share: Column, holds_text: Column, least: float = 0.9) -> DataFrame:
    """Pictures that cover at least so much of a place where no element holds text."""
    editable = elements.where(holds_text).select(*place).distinct()
    return pictures.where(share >= least).join(editable, list(place), "left_anti")


def rename_plan(files: DataFrame, target: str, present: DataFrame, name: str) -> DataFrame:
    """Proposed names that no file has yet."""
    return files.join(present.select(F.col(name).alias(target)).distinct(), target, "left_anti")


def listing(files: DataFrame, name: str, extensions: Sequence[str]) -> DataFrame:
    """Files with one of the extensions in any case, no lock files, with the ``sort_name`` of a listing."""
    ending = F.lower(F.element_at(F.split(name, r"\."), -1))
    return files.where(ending.isin(*[e.lower().lstrip(".") for e in extensions]) & ~F.col(name).startswith("~$")).withColumn("sort_name", F.lower(name))


def _levels(path: str, last: int) -> Column:
    """The path's beginnings, down to ``last`` parts before its end."""
    parts = F.split(path, "/")
    depth = F.size(parts) - last
    return F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), n.alias("level"), (n < F.size(parts)).alias("folder"))))


def folder_tree(files: DataFrame, path: str) -> DataFrame:
    """Folders above every file, with their depth and the files beneath; counts combine map-side."""
    above = files.select(F.explode(_levels(path, 1)).alias("a"))
    return above.groupBy(F.col("a.path").alias("folder"), F.col("a.level").alias("depth")).agg(F.count(F.lit(1)).alias("files"))


def tree(paths: DataFrame, path: str) -> DataFrame:
    """Folders and files once each, with their level, parent and ``position`` in the tree's listing:
    parents in order, in each folders first, then by name without case. Numbered by ranges."""
    every = paths.select(F.explode(_levels(path, 0)).alias("s")).select("s.*").distinct()
    named = every.withColumn("sort_name", F.lower(F.element_at(F.split("path", "/"), -1))).withColumn("parent", F.regexp_replace("path", "/?[^/]*$", ""))
    return runtime.numbered_within(named.withColumn("_file", ~F.col("folder")), [], ["parent", "_file", "sort_name", "path"], "position").drop("_file")


def ranked_by_mapped_keys(rows: DataFrame, order: Mapping[str, Column], name: str = "position") -> DataFrame:
    """Rows with their place, from 1, in the order of derived keys that together are unique; no global sort in one task."""
    keyed = rows
    for key, column in order.items():
        keyed = keyed.withColumn(key, column)
    return runtime.numbered_within(keyed, [], list(order), name)


def auto_outline(lines: DataFrame, doc: str, page: str, is_heading: Column, least: int = 3) -> DataFrame:
    """Headings as an outline; a document with fewer than ``least`` of them gets one entry per page.

    The count of headings reaches its document by a join of one row each.
    """
    counted = lines.groupBy(doc).agg(F.count_if(is_heading).alias("_n"), F.max(page).alias("_last"))
    rich = counted.where(F.col("_n") >= least).select(doc)
    outline = lines.where(is_heading).join(rich, doc, "left_semi").select(doc, F.col(page).alias("page"), F.lit("heading").alias("kind"))
    plain = counted.where(F.col("_n") < least).select(doc, F.explode(F.sequence(F.lit(1), "_last")).alias("page"), F.lit("page").alias("kind"))
    return outline.unionByName(plain)


def first_filled_of(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])
