"""Exact duplicates by key, with group representatives in place of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calyx import runtime


def duplicate_members(records: DataFrame, key: str, group: Column) -> DataFrame:
    """``key, first_id, copies`` of the members of groups of two or more rows.

    Rows with a null group value belong to no group. Only the key and the group's
    value are shuffled.
    """
    keyed = records.select(key, group.alias("_group")).where(F.col("_group").isNotNull())
    found = runtime.attach_group(keyed, ["_group"], [F.min(key).alias("first_id"), F.count(F.lit(1)).alias("copies")])
    return found.where("copies > 1").drop("_group")
