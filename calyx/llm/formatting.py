"""Records that differ only in formatting: collapsed in two steps, with counts.

1. Byte-identical raw records collapse first, with their number and smallest id;
   the grouping combines map-side, so a record copied a billion times is one row
   before anything is canonicalised.
2. Only the distinct survivors are canonicalised, by built-in string functions,
   and grouped again on the SHA-256 of the full canonical text.

Canonical text: compatibility letters stay as they are; upper and then lower case
removes case; everything but letters, marks and numbers of any script goes, which
covers white space, invisible characters, punctuation and signs. The leading run
of labelled fields is sorted, each label with its value; later lines keep their
order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calyx import runtime

#: The labels of the fields a first page may begin with, after any of the separators.
FIELD_LABELS = (
    "Document No", "Protocol", "Document Type", "Version", "Release Date", "Site", "Prepared By", "Checked By",
    "文件编号", "方案编号", "文件类型", "版本", "发布日期", "中心", "编制", "审核",
)

#: Marks that never show: zero-width characters, soft hyphen, bidirectional marks, variation selectors.
INVISIBLE = r"\u00AD\u034F\u061C\u180B-\u180F\u200B-\u200F\u202A-\u202E\u2060-\u206F\uFE00-\uFE0F\uFEFF"
#: Anything that is no letter, mark or number, of any script.
NOISE = r"[^\p{L}\p{M}\p{N}]+"
#: Marks that never show: zero-width characters, soft hyphen, bidirectional marks, variation selectors.
INVISIBLE = r"\u00AD\u034F\u061C\u180B-\u180F\u200B-\u200F\u202A-\u202E\u2060-\u206F\uFE00-\uFE0F\uFEFF"
#: Where a field ends.
FIELD_END = r"[\n\r\u000B\u000C\u0085\u2028\u2029;\uFF1B|\uFF5C]+"


def _visible(text: Column) -> Column:
    return F.regexp_replace(text, f"[{INVISIBLE}]+", "")


def _letters(text: Column) -> Column:
    return F.lower(F.upper(F.regexp_replace(text, NOISE, "")))


def fold(text: Column) -> Column:
    """Letters, marks and numbers only, without case."""
    return _letters(_visible(text))


def _field_pattern(labels: Sequence[str]) -> str:
    """How a field begins: a known label and any separator, or one to four words, or
    up to eight Han characters, and a colon or equals sign."""
    gap = r"[^\p{L}\p{M}\p{N}\r\n]*"
    names = "|".join(gap.join(label.replace(" ", "")) for label in labels)
    # the labels are looked for only where a segment begins with a letter of one
    starts = "".join(sorted({c for label in labels for c in (label[0].lower(), label[0].upper())}))
    known = rf"(?=[{starts}])(?iu:{names}){gap}[:\uFF1A=\uFF1D\-\u2010-\u2015\u2212\uFF0D_/]" if labels else "(?!)"
    word = r"[\p{L}\p{M}\p{N}]{1,20}+"
    other = rf"(?:{word}(?:[^\p{{L}}\p{{M}}\p{{N}}\r\n:\uFF1A=\uFF1D]{{1,3}}+{word}){{0,3}}+|\p{{IsHan}}{{2,8}}+){gap}[:\uFF1A=\uFF1D]"
    return rf"^{gap}+(?:{known}|{other})"


def canonical_text(text: Column, labels: Sequence[str] = FIELD_LABELS) -> Column:
    """The canonical form of ``text``; null stays null.

    Fields end at a line break, semicolon or vertical bar. The leading segments
    that begin with a label and a separator are the fields; blank segments and
    rules of signs between them are skipped. A label need not be listed: a short
    head before a colon or equals sign is one. ``labels`` are those that also stand
    before dashes, slashes and underscores.
    """
    parts = F.filter(F.split(_visible(text), FIELD_END), lambda p: p.rlike(r"[\p{L}\p{M}\p{N}]"))
    # label and value stay apart by a tab, so that a longer label never meets a shorter value
    first_other = F.array_position(F.transform(parts, lambda p: p.rlike(_field_pattern(labels))), False)
    head = F.when(first_other == 0, F.size(parts)).otherwise(first_other - 1).cast("int")
    fields = F.sort_array(F.transform(F.slice(parts, F.lit(1), head), _letters))
    rest = _letters(F.array_join(F.slice(parts, head + 1, F.size(parts)), ""))
    return F.concat(F.array_join(fields, "\t"), F.lit("\n"), rest)


def _usable(records: DataFrame, key: str, name: str, text: str) -> DataFrame:
    shown = F.col(key).isNotNull() & F.col(text).rlike(rf"(?U)[^\s{INVISIBLE}]")
    return records.where(shown).select(
        F.col(key).alias("key"), F.coalesce(F.col(name), F.lit("")).alias("name"), F.col(text).alias("text"),
        F.sha2(F.concat_ws("\u0001", F.coalesce(F.col(name), F.lit("")), F.col(text)), 256).alias("raw"),
    )


def raw_survivors(records: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """One row per byte-identical record, ``raw, raw_first, raw_rows, canon``."""
    raw = _usable(records, key, name, text).groupBy("raw").agg(
        F.min("key").alias("raw_first"), F.first("name").alias("name"), F.first("text").alias("text"),
        F.count(F.lit(1)).alias("raw_rows"),
    )
    canon = F.sha2(F.concat_ws("\u0001", fold(F.col("name")), canonical_text(F.col("text"))), 256)
    return raw.select("raw", "raw_first", "raw_rows", canon.alias("canon"))


def collapse_formatting(records: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """One row per group of records that differ only in formatting.

    ``first_id`` is the smallest key of the group, ``spellings`` the number of its
    byte-different forms, ``copies`` the number of its different keys and
    ``copied_rows`` that of its rows, repeats included. Records with a null key, or
    whose text is null or blank (white space and invisible marks only), are kept
    out; a null name counts as an empty one.
    """
    survivors = runtime.cut(raw_survivors(records, key, name, text), "formatting")
    held = _usable(records, key, name, text).select("key", "raw")
    # many keys may hold one form: they are counted by form first, then by group
    keys = held.distinct().groupBy("raw").agg(F.count(F.lit(1)).alias("raw_keys"))
    by_form = survivors.join(keys, "raw")
    groups = by_form.groupBy("canon").agg(
        F.min("raw_first").alias("first_id"), F.count(F.lit(1)).alias("spellings"), F.sum("raw_keys").alias("copies"), F.sum("raw_rows").alias("copied_rows")
    )
    return groups.drop("canon")


def formatting_copies(records: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """``first_id, copy_id`` for every key of a group but its smallest.

    A key whose rows carry different texts belongs to each of their groups.
    """
    survivors = runtime.cut(raw_survivors(records, key, name, text), "formatting")
    total = survivors.agg(F.count(F.lit(1)), F.sum("raw_rows")).first()
    named = runtime.attach_group(
        survivors, ["canon"],
        [F.min("raw_first").alias("first_id"), F.sum("raw_rows").alias("group_rows")],
        runtime.hot_threshold(total[0]),
    ).where("group_rows > 1")
    heavy = runtime.hot_threshold(int(total[1] or 0))
    hot = named.where(F.col("raw_rows") > heavy).select("raw", "first_id")
    cold = named.where(F.col("raw_rows") <= heavy).select("raw", "first_id")
    ids = _usable(records, key, name, text).select("key", "raw")
    cool_ids = ids.join(F.broadcast(hot.select("raw")), "raw", "left_anti")
    pairs = ids.join(F.broadcast(hot), "raw").unionByName(cool_ids.join(cold, "raw"))
    return pairs.where("key != first_id").select("first_id", F.col("key").alias("copy_id")).distinct()
