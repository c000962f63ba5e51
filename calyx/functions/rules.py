"""Rules as expressions: classifiers, label matching, slots, stale files, folder risks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from calyx.functions.identifiers import squeeze
from calyx.functions.numbers import count_and_share, event_count

#: The column pairs (n and share, events) of the five groups, in output order.
GROUP_COLUMNS = ((5, 6), (7, 8), (1, 2), (3, 4), (9, 10))
GRADES = ("1级", "2级", "3级", "4级", "5级", "≥3级")
HEADER_WORDS = ("首选术语", "系统器官", "年龄组", "不良事件", "n(%)", "例次")
FOOTER_WORDS = ("使用MedDRA", "数据来源", "百分比", "合同研究", "方案编号", "年龄组", "系统器官", "首选术语", "低剂量佐剂组", "高剂量佐剂组", "低剂量试验组", "高剂量试验组", "安慰剂组", "合计", "若受试者")


def any_of(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def all_of(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(True)
    for w in words:
        hit = hit & text.contains(w)
    return hit


def first_filled(cells: Column, limit: int = 4) -> Column:
    """The first of the first cells that is not blank; empty if all are."""
    filled = F.filter(F.slice(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), F.lit(1), F.lit(limit)), lambda c: c != "")
    return F.coalesce(F.get(filled, F.lit(0)), F.lit(""))


def group_values(cells: Column, columns: Sequence[tuple[int, int]] = GROUP_COLUMNS) -> Column:
    """(events, subjects, share) of every group; nulls where neither is given, else 0 for what is missing."""
    out = []
    for n_at, events_at in columns:
        parsed = count_and_share(F.coalesce(F.get(cells, F.lit(n_at)), F.lit("")))
        events = event_count(F.coalesce(F.get(cells, F.lit(events_at)), F.lit("")))
        none = parsed.isNull() & events.isNull()
        out.append(F.struct(
            F.when(~none, F.coalesce(events, F.lit(0))).alias("events"), F.when(~none, F.coalesce(parsed["n"], F.lit(0))).alias("subjects"),
            F.when(~none, F.coalesce(parsed["share"], F.lit(0.0))).alias("share"),
        ))
    return F.array(*out)


def row_kind(first: Column) -> Column:
    """grade, total, class (of organs), header, number or term: the first rule that fits; blank rows are header."""
    s = F.trim(F.coalesce(first, F.lit("")))
    organ = any_of(s, ["系统", "疾病"]) | s.endswith("反应") | s.endswith("检查") | (s.contains("及") & any_of(s, ["组织", "器官"]))
    return (
        F.when(s == "", "header").when(s.isin(*GRADES), "grade").when(s == "Total", "total").when(s.isin(*HEADER_WORDS) | any_of(s, FOOTER_WORDS), "header")
        .when(s.rlike(r"^[\d\s.()%]+$"), "number").when(organ, "class").otherwise("term")
    )


def sheet_type(name: Column) -> Column:
    """What a sheet holds, by its name; the growth index outranks the titre."""
    s = F.upper(name)
    return F.when(s.contains("GMI"), "GMI").when(s.contains("GMC") | s.contains("GMT"), "GMC").when(s.contains("阳转") | s.contains("RATE"), "rate").otherwise("other")


def labels_match(cell: Column, target: Column, empty_matches: bool = False) -> Column:
    """Equal, one inside the other, or all words of the target in the cell.

    An empty cell matches nothing; ``empty_matches`` gives the older rule.
    """
    a, b = F.lower(squeeze(F.coalesce(cell, F.lit("")))), F.lower(squeeze(F.coalesce(target, F.lit(""))))
    words = F.regexp_extract_all(b, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    hit = (a == b) | a.contains(b) | b.contains(a) | ((F.size(words) > 0) & F.forall(words, lambda w: a.contains(w)))
    return (b != "") & (F.lit(empty_matches) | (a != "")) & hit


def slot_matches(title: Column, text: Column, rule: Mapping[str, Sequence[str]]) -> Column:
    """A conjunction of title_all, title_any, title_also_any, text_all and content_any; no rule, no match."""
    if not rule:
        return F.lit(False)
    whole = F.concat_ws("\n", title, text)
    title = F.trim(F.coalesce(title, F.lit("")))
    hit = F.lit(True)
    for key, test, where in (("title_all", all_of, title), ("title_any", any_of, title), ("title_also_any", any_of, title), ("text_all", all_of, whole), ("content_any", any_of, whole)):
        if key in rule:
            hit = hit & test(where, [w.strip() for w in rule[key] if w.strip()])
    return hit


def script_place(title: Column, script: Sequence[tuple[str, Sequence[Sequence[str]]]]) -> Column:
    """(chapter, slot) of the first phrase that the title holds, or that holds the title, in the script's order."""
    s = squeeze(F.coalesce(title, F.lit("")))
    out = F.lit(None).cast("struct<chapter:string,slot:int>")
    for chapter, slots in reversed(list(script)):
        for slot in range(len(slots) - 1, -1, -1):
            for phrase in reversed(list(slots[slot])):
                hit = (s != "") & (s.contains(phrase) | F.lit(phrase).contains(s))
                out = F.when(hit, F.struct(F.lit(chapter).alias("chapter"), F.lit(slot).alias("slot"))).otherwise(out)
    return out


def keyword_bag(text: Column, words: Sequence[str], prefix: int = 3) -> Column:
    """Any keyword in the text, or its first letters in one of the text's words."""
    s = F.lower(text)
    tokens = F.filter(F.split(s, r"\s+"), lambda t: t != "")
    hit = any_of(s, [w.lower() for w in words])
    for w in words:
        if len(w) >= prefix:
            head = F.lit(w.lower()[:prefix])
            hit = hit | F.exists(tokens, _begins(head))
    return (F.trim(s) != "") & hit


def _begins(head: Column):
    return lambda token: token.contains(head) | head.contains(token)


def slide_score(shapes: Column, has_table: Column, text: Column, numbers: Sequence[str] = (), wanted: Sequence[str] = (), table_bonus: bool = True) -> Column:
    """Ten a shape, and bonuses for a table, for one of the numbers and for a wanted word."""
    s = F.lower(F.coalesce(text, F.lit("")))
    score = F.coalesce(shapes, F.lit(0)) * 10
    if table_bonus:
        score = score + F.when(has_table, 100).otherwise(0)
    score = score + F.when(any_of(s, [n.lower() for n in numbers]), 50).otherwise(0)
    return score + F.when(any_of(s, [w.lower() for w in wanted]), 200).otherwise(0)


def chapter(text: Column, forced: tuple[str, Sequence[str]], chapters: Sequence[tuple[str, Sequence[str]]], default: str | None = None) -> Column:
    """The forced chapter first, then the others in order, then by digits and hints; else the default."""
    s = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(F.trim(s) == "", F.lit(default).cast("string")).when(any_of(s, [w.lower() for w in forced[1]]), forced[0])
    for name, words in chapters:
        out = out.when(any_of(s, [w.lower() for w in words]), name)
    digits = s.rlike(r"\d")
    return out.when(digits & any_of(s, ["安全", "safety", "不良", "adverse"]), "3").when(digits & any_of(s, ["%", "percent", "百分比", "总体", "overview"]), "2").otherwise(F.lit(default).cast("string"))


def stale_reasons(size: Column, name: Column, extensions: Sequence[str]) -> Column:
    return F.array_compact(F.array(F.when(size == 0, F.lit("empty")), F.when(F.lower(F.substring_index(name, ".", -1)).isin(*extensions), F.lit("extension"))))


def is_stale(modified: Column, now: Column, days: int) -> Column:
    return modified <= now - F.expr(f"INTERVAL {days} DAYS")


def folder_risk(path: Column, size: Column, dangerous: Sequence[str], caches: Sequence[str], large: int) -> Column:
    """dangerous, safe, review or null (left alone); the first rule wins. Small folders to review are left alone."""
    s = F.lower(path)
    return F.when(any_of(s, dangerous), "dangerous").when(any_of(s, caches), "safe").when(size >= large, "review")
