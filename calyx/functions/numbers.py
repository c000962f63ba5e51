"""Numbers in noisy text: estimates with intervals, counts, rates and sizes.

Every parser returns null, or a null struct, where the text does not fit; casts
never fail under ANSI mode. A struct is null unless all of its parts parse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUM = r"([\d.]+)"
_DEC = r"([0-9]+(?:\.[0-9]+)?)"
_OPEN, _SHUT, _COMMA = "[（(]", "[)）]", "[,，]"


def number(text: Column) -> Column:
    return text.try_cast("double")


def part(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null if there is none."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def _all_or_none(struct: Column, *parts: Column) -> Column:
    complete = parts[0].isNotNull()
    for p in parts[1:]:
        complete = complete & p.isNotNull()
    return F.when(complete, struct)


def estimate(text: Column) -> Column:
    """``768.17(507.87, 1161.89)`` as (mean, upper, lower); a bare number as (mean, null, null)."""
    pattern = rf"{_NUM}\s*\(\s*{_NUM}\s*,\s*{_NUM}\s*\)"
    mean, lower, upper = (number(part(text, pattern, g)) for g in (1, 2, 3))
    full = F.struct(mean.alias("mean"), upper.alias("upper"), lower.alias("lower"))
    none = F.lit(None).cast("double")
    bare = number(F.trim(text))
    return F.coalesce(
        _all_or_none(full, mean, upper, lower),
        F.when(~text.rlike(pattern) & bare.isNotNull(), F.struct(bare.alias("mean"), none.alias("upper"), none.alias("lower"))),
    )


def rate_percent(text: Column) -> Column:
    """``24 (75.00)`` as 75.0; a plain number passes through."""
    return F.coalesce(number(part(text, rf"\(\s*{_NUM}\s*\)", 1)), number(F.trim(text)))


def interval(text: Column) -> Column:
    """``56.60, 88.54`` as (lower, upper)."""
    pattern = rf"{_NUM}\s*[,，]\s*{_NUM}"
    lower, upper = number(part(text, pattern, 1)), number(part(text, pattern, 2))
    return _all_or_none(F.struct(lower.alias("lower"), upper.alias("upper")), lower, upper)


def triple(text: Column) -> Column:
    """``mid(lo, up)`` as (lo, mid, up): percent form first, then plain, then one value three times."""
    forms = []
    for unit in ("%", ""):
        pattern = rf"{_DEC}{unit}\s*{_OPEN}\s*{_DEC}{unit}\s*{_COMMA}\s*{_DEC}{unit}\s*{_SHUT}"
        forms.append(with_value(F.regexp_extract_all(F.regexp_extract(text, pattern, 0), F.lit(_DEC), F.lit(1)), _three))
    one = number(part(text, _DEC, 1))
    forms.append(_all_or_none(F.struct(one.alias("lo"), one.alias("mid"), one.alias("up")), one))
    return F.coalesce(*forms)


def with_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _three(found: Column) -> Column:
    mid, lo, up = (number(F.get(found, F.lit(i))) for i in range(3))
    return _all_or_none(F.struct(lo.alias("lo"), mid.alias("mid"), up.alias("up")), lo, mid, up)


def count_and_share(text: Column) -> Column:
    """``3 ( 30.00)`` as (n, share) with the share as a fraction."""
    pattern = rf"^\s*(\d+)\s*\(\s*{_NUM}\s*\)"
    n, share = part(text, pattern, 1).try_cast("int"), number(part(text, pattern, 2)) / 100
    return _all_or_none(F.struct(n.alias("n"), share.alias("share")), n, share)


def event_count(text: Column) -> Column:
    """A count; blank and a dash are 0, decimals are cut off, other text is null, null stays null."""
    plain = F.trim(text)
    return F.when(plain.isin("", "-"), F.lit(0)).otherwise(number(plain).try_cast("int"))


def first_number(text: Column) -> Column:
    return number(part(text, r"([-+]?\d+(?:\.\d+)?)", 1))


def tidy(value: Column) -> Column:
    """Whole numbers without a point, others with up to four decimals and no closing zeros."""
    text = F.rtrim(F.format_string("%.4f", value), F.lit("0"))
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(F.rtrim(text, F.lit(".")))


def as_fraction(value: Column, is_proportion: Column) -> Column:
    """Values above 1 of a series of proportions are percentages."""
    return F.when(is_proportion & (value > 1), value / 100).otherwise(value)


def throughput_mbps(n_bytes: Column, seconds: Column) -> Column:
    """Megabits a second, rounded half to even; null without time or data."""
    return F.when((seconds > 0) & (n_bytes > 0), F.bround(n_bytes * 8 / seconds / 1_000_000, 2))


def readable_size(n_bytes: Column) -> Column:
    """The largest unit of 1024 that leaves at least 1, with one decimal (half to even); plain bytes below."""
    size = F.lit(None).cast("string")
    out = F.when(n_bytes < 1024, F.concat(n_bytes.cast("long").cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        value = F.format_string(f"%.1f {unit}", F.bround(n_bytes / float(1024**power), 1))
        out = out.when(n_bytes < 1024.0 ** (power + 1), value)
    return F.when(n_bytes.isNotNull(), out.otherwise(F.format_string("%.1f TB", F.bround(n_bytes / float(1024**4), 1)))).otherwise(size)


def close(a: Column, b: Column, tolerance: float, relative: float = 0.0) -> Column:
    """Equal within tolerance; two nulls are equal, one null is not."""
    near = F.abs(a - b) <= F.greatest(F.lit(tolerance), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))
    return a.eqNullSafe(b) | F.coalesce(near, F.lit(False))


def axis_bounds(lowest: Column, highest: Column, pad: float, step: float) -> Column:
    """(low, high, step): the range padded by a share of it and rounded outwards to the step."""
    width = (highest - lowest) * pad
    low = F.greatest(F.floor((lowest - width) / step) * step, F.lit(0.0))
    return F.struct(low.alias("low"), (F.ceil((highest + width) / step) * step).alias("high"), F.lit(step).alias("step"))
