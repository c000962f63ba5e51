"""Small decisions over headers, styles and providers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calyx.functions.identifiers import is_note

#: Words of a sub-header that name the note and the value.
NOTE_HEADS, VALUE_HEADS = ("说明", "判定", "备注"), ("结果", "数值", "浓度")


def value_and_note(cells: Column, sub: Column) -> Column:
    """(value, note) of the cells of one marker.

    With a sub-header the first cell under a value word and the first under a note
    word count; else the first cell that is a note is the note, and the first other
    filled one is the value.
    """
    clean = F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))))
    under = lambda words: F.get(F.filter(F.transform(clean, lambda c, i: F.when(_names(F.get(sub, i), words), c)), lambda c: c.isNotNull()), F.lit(0))
    filled = F.filter(clean, lambda c: c != "")
    note = F.coalesce(F.get(F.filter(filled, is_note), F.lit(0)), F.lit(""))
    value = F.coalesce(F.get(F.filter(filled, lambda c: ~is_note(c)), F.lit(0)), F.lit(""))
    headed = F.struct(F.coalesce(under(VALUE_HEADS), value).alias("value"), F.coalesce(under(NOTE_HEADS), note).alias("note"))
    return F.when(sub.isNotNull(), headed).otherwise(F.struct(value.alias("value"), note.alias("note")))


def _names(head: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.coalesce(head.contains(w), F.lit(False))
    return hit


def style_name(name: Column, outline: Column, classes: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """``heading n`` by outline level, else the first class one of whose words the name holds, else body."""
    out = F.when(outline.between(1, 9), F.concat(F.lit("heading "), outline.cast("string")))
    for label, words in classes:
        out = out.when(_names(name, words), label)
    return out.otherwise("body")


def internal_name(value: Column) -> Column:
    token = F.regexp_replace(value, r"[^A-Za-z0-9+._-]", "")
    return F.when(token != "", token)


def first_working(rows: DataFrame, providers: Sequence[tuple[str, Column]], probes: int = 5) -> tuple[str, Column]:
    """The first provider that answers a few probe rows; its expression then serves all rows."""
    sample = rows.limit(probes)
    for name, answer in providers:
        tested = sample.agg(F.count(F.lit(1)).alias("n"), F.count(answer).alias("ok")).first()
        if tested.n == tested.ok:
            return name, answer
    raise ValueError("no provider answers")
