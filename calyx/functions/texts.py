"""Text operators: replacement rules, snippets around keywords, scanned lines, JSON in answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from calyx.functions.identifiers import MARKERS, scanned_sample_id
from calyx.functions.numbers import part


def quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}-/" else c for c in text)


class Rules:
    """Replacement rules: literals first, the longest first, then regular expressions, each on what the last left."""

    def __init__(self, literals: Sequence[tuple[str, str]] = (), regexes: Sequence[tuple[str, str]] = ()):
        self.literals = sorted(dict(literals).items(), key=lambda kv: -len(kv[0]))
        self.regexes = list(regexes)

    def apply(self, text: Column) -> Column:
        for old, new in self.literals:
            text = F.replace(text, F.lit(old), F.lit(new))
        for pattern, new in self.regexes:
            text = F.regexp_replace(text, pattern, new)
        return text

    def count(self, text: Column) -> Column:
        """Hits of every rule in the text as given."""
        hits = F.lit(0)
        for pattern in (*(quoted(old) for old, _ in self.literals), *(p for p, _ in self.regexes)):
            hits = hits + F.regexp_count(text, F.lit(pattern))
        return hits

    def replaced(self, text: Column) -> Column:
        """Replacements made when the rules run one after the other."""
        total = F.lit(0)
        for old, new in self.literals:
            total = total + F.regexp_count(text, F.lit(quoted(old)))
            text = F.replace(text, F.lit(old), F.lit(new))
        for pattern, new in self.regexes:
            total = total + F.regexp_count(text, F.lit(pattern))
            text = F.regexp_replace(text, pattern, new)
        return total


def written_back(runs: Column, text: Column) -> Column:
    """A replaced text put back into its runs: cut anew if its length is the same, else all in the first run."""
    lengths = F.transform(runs, lambda r: F.length(r))
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    ends = lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x)
    cut = F.transform(runs, lambda r, i: F.substring(text, F.when(i > 0, ends(F.greatest(i, F.lit(1)))).otherwise(0) + 1, F.length(r)))
    first = F.transform(runs, lambda r, i: F.when(i == 0, text).otherwise(F.lit("")))
    return F.when(F.length(text) == total, cut).otherwise(first)


def snippets(text: Column, keyword: str, context: int = 500, misaligned: bool = False) -> Column:
    """Text around each hit of the keyword: ``context`` characters before and after.

    ``misaligned`` gives what an older report printed: what follows hit i, the
    keyword, and what follows hit i + 1, cut at twice the context.
    """
    pieces = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), quoted(keyword))
    at = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: i > 0)
    if misaligned:
        return F.transform(at, lambda i: F.trim(F.left(F.concat(F.right(F.get(pieces, i), F.lit(context)), F.lit(keyword), F.left(F.coalesce(F.get(pieces, i + 1), F.lit("")), F.lit(context))), F.lit(2 * context))))
    return F.transform(at, lambda i: F.trim(F.concat(F.right(F.get(pieces, i - 1), F.lit(context)), F.lit(keyword), F.left(F.get(pieces, i), F.lit(context)))))


def keyword_windows(text: Column, keywords: Sequence[str], window: int, least: int, cap: int, mark: str = "\n\n...[cut]...\n\n") -> Column:
    """Merged windows around keywords: short texts stay, texts without a hit keep their beginning, the result is capped."""
    any_word = "(?i)(" + "|".join(map(quoted, keywords)) + ")"
    parts = F.split(text, any_word)
    hits = F.regexp_extract_all(text, F.lit(any_word), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"))

    def step(acc: Column, i: Column) -> Column:
        begin = acc["at"] + F.length(F.get(parts, i))
        end = begin + F.length(F.get(hits, i))
        span = F.struct(F.greatest(F.lit(0), begin - window).alias("s"), F.least(F.length(text), end + window).alias("e"))
        last = F.try_element_at(acc["spans"], F.lit(-1))
        joined = F.concat(F.slice(acc["spans"], F.lit(1), F.greatest(F.size(acc["spans"]) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], span["e"]).alias("e"))))
        spans = F.when((F.size(acc["spans"]) > 0) & (span["s"] <= last["e"]), joined).otherwise(F.concat(acc["spans"], F.array(span)))
        return F.struct(end.alias("at"), spans.alias("spans"))

    order = F.filter(F.sequence(F.lit(0), F.greatest(F.size(hits), F.lit(1)) - 1), lambda i: i < F.size(hits))
    spans = F.aggregate(order, start, step)["spans"]
    cut = F.array_join(F.transform(spans, lambda s: F.substring(text, s["s"] + 1, s["e"] - s["s"])), mark)
    return F.when(F.length(text) < least, text).when(F.size(hits) == 0, F.left(text, F.lit(least))).otherwise(F.left(cut, F.lit(cap)))


def _note(raw: Column) -> Column:
    return F.when(raw.isin("阴", "陰性", "陰"), "阴性").when(raw.isin("阳", "陽", "陽性"), "阳性").otherwise(raw)


def clean_value(raw: Column) -> Column:
    """The number with its sign, else the first word."""
    s = F.trim(F.replace(F.coalesce(raw, F.lit("")), F.lit("�"), F.lit("")))
    return F.coalesce(part(s, r"^([<≥\d.]+)", 1), F.substring_index(s, " ", 1))


def scanned_line(line: Column) -> Column:
    """A scanned line as (sample, pairs of value and note): by its bars, else by tokens in order.

    Null where no sample id, or no pair, is found. A note takes the last value before it.
    """
    bars = F.transform(F.split(line, r"\|"), lambda p: F.trim(p))
    by_bar = F.struct(
        scanned_sample_id(F.get(bars, F.lit(1))).alias("sample"),
        F.transform(F.sequence(F.lit(0), F.lit(len(MARKERS) - 1)), lambda i: F.struct(clean_value(F.get(bars, i * 2 + 2)).alias("value"), F.trim(F.coalesce(F.get(bars, i * 2 + 3), F.lit(""))).alias("note"))).alias("pairs"),
    )
    id_pattern = r"([\w\d]+)[\s\-—–_]+([\w\d]+)[\s\-—–_]+([A-Za-z0-9]+)"
    ids = F.concat_ws("-", *[part(line, id_pattern, g) for g in (1, 2, 3)])
    rest = F.regexp_replace(F.concat(line, F.lit("")), "^(.*?)" + id_pattern, "$1 ")
    tokens = F.regexp_extract_all(rest, F.lit(r"([<≤]?\s*\d+(?:\.\d+)?|[≥>]\s*\d+(?:\.\d+)?|阴性|陰性|阳性|陽性|阴|陽|阳|反应|可疑|待查)"), F.lit(1))
    start = F.struct(F.lit("").alias("value"), F.array().cast("array<struct<value:string,note:string>>").alias("pairs"))

    def step(acc: Column, t: Column) -> Column:
        is_value = t.rlike(r"\d")
        pair = F.array(F.struct(acc["value"].alias("value"), _note(t).alias("note")))
        done = F.struct(F.lit("").alias("value"), F.concat(acc["pairs"], pair).alias("pairs"))
        return F.when(is_value, F.struct(clean_value(t).alias("value"), acc["pairs"].alias("pairs"))).when(acc["value"] != "", done).otherwise(acc)

    pairs = F.slice(F.aggregate(tokens, start, step)["pairs"], 1, len(MARKERS))
    by_token = F.struct(scanned_sample_id(ids).alias("sample"), pairs.alias("pairs"))
    barred = (F.size(bars) >= 12) & F.get(bars, F.lit(0)).rlike(r"^[-+]?\d+$") & by_bar["sample"].contains("-")
    found = F.when(barred, by_bar).when((F.size(bars) < 12) & part(line, id_pattern, 1).isNotNull() & (F.size(pairs) > 0), by_token)
    return found


def json_text(answer: Column) -> Column:
    """The JSON in an answer: without code fences if it parses, else from the first to the last brace."""
    s = F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*|\s*```$", "")
    parsed = F.try_parse_json(s)
    return F.when(parsed.isNotNull(), s).otherwise(part(s, r"(?s)(\{.*\})", 1))


def required_first(json: Column, required: Sequence[str]) -> Column:
    """(required fields as a struct, all others as a map); a field that is missing is null."""
    fields = F.from_json(json, "map<string,string>")
    known = F.struct(*[F.try_element_at(fields, F.lit(k)).alias(k) for k in required])
    return F.struct(known.alias("fields"), F.map_filter(fields, lambda k, v: ~k.isin(*required)).alias("extra"))


def warning_summary(text: Column, limit: int = 500) -> Column:
    """Distinct non-blank lines of a log in one line, cut at the limit."""
    lines = F.array_distinct(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""))
    whole = F.array_join(lines, "; ")
    return F.when(F.length(whole) > limit, F.concat(F.left(whole, F.lit(limit - 3)), F.lit("..."))).otherwise(whole)


def cell_text(text: Column, limit: int = 32_000) -> Column:
    """A text that fits a cell: cut with three points."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def bookmark_title(text: Column, limit: int = 180) -> Column:
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F]", " "), r"(?U)\s+", " ")), F.lit(limit))
