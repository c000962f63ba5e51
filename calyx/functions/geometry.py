"""Boxes ``struct<x0, top, x1, bottom>`` on pages: rotation, clamping, overlap, union.

A box is bound once in each function, so that expressions of functions of functions stay small.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calyx.functions.numbers import with_value

_SIDES = ("x0", "top", "x1", "bottom")


def box(x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x0, top, x1, bottom), _SIDES)])


def area(b: Column) -> Column:
    size = with_value(b, lambda v: F.struct((v["x1"] - v["x0"]).alias("w"), (v["bottom"] - v["top"]).alias("h")))
    return with_value(size, lambda v: F.when((v["w"] > 0) & (v["h"] > 0), v["w"] * v["h"]).otherwise(0.0))


def _both(a: Column, b: Column, body) -> Column:
    return with_value(F.struct(a.alias("a"), b.alias("b")), lambda v: body(v["a"], v["b"]))


def overlaps(a: Column, b: Column) -> Column:
    """Touching edges count."""
    return _both(a, b, lambda a, b: (a["x1"] >= b["x0"]) & (a["x0"] <= b["x1"]) & (a["bottom"] >= b["top"]) & (a["top"] <= b["bottom"]))


def union(a: Column, b: Column) -> Column:
    return _both(a, b, lambda a, b: box(F.least(a["x0"], b["x0"]), F.least(a["top"], b["top"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["bottom"], b["bottom"])))


def clamped(b: Column, width: Column, height: Column) -> Column:
    """The part on the page; null if nothing is."""
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    out = with_value(b, lambda v: box(inside(v["x0"], width), inside(v["top"], height), inside(v["x1"], width), inside(v["bottom"], height)))
    return with_value(out, lambda v: F.when((v["x1"] > v["x0"]) & (v["bottom"] > v["top"]), v))


def quarter(rotation: Column) -> Column:
    """Degrees as 0, 90, 180 or 270; other angles count as none."""
    r = F.pmod(F.coalesce(rotation, F.lit(0)), F.lit(360))
    return F.when(r.isin(90, 180, 270), r).otherwise(0)


def rotated(b: Column, source: Column, target: Column, width: Column, height: Column) -> Column:
    """A box of a page seen at one rotation, as it lies at another; width and height are those of the source frame."""
    page = F.struct(b.alias("b"), quarter(source).alias("s"), quarter(target).alias("t"), width.alias("w"), height.alias("h"))

    def base(v: Column) -> Column:
        s, w, h = v["s"], v["w"], v["h"]
        across = lambda x, y: F.when(s == 90, y).when(s == 180, w - x).when(s == 270, h - y).otherwise(x)
        down = lambda x, y: F.when(s == 90, w - x).when(s == 180, h - y).when(s == 270, x).otherwise(y)
        swap = s.isin(90, 270)
        corners = [f(v["b"][x], v["b"][y]).alias(n) for f, x, y, n in ((across, "x0", "top", "ax"), (down, "x0", "top", "ay"), (across, "x1", "bottom", "bx"), (down, "x1", "bottom", "by"))]
        return F.struct(*corners, v["t"].alias("t"), F.when(swap, h).otherwise(w).alias("w"), F.when(swap, w).otherwise(h).alias("h"))

    def placed(v: Column) -> Column:
        t, w, h = v["t"], v["w"], v["h"]
        across = lambda x, y: F.when(t == 90, h - y).when(t == 180, w - x).when(t == 270, y).otherwise(x)
        down = lambda x, y: F.when(t == 90, x).when(t == 180, h - y).when(t == 270, w - x).otherwise(y)
        corners = [f(v[x], v[y]) for f in (across, down) for x, y in (("ax", "ay"), ("bx", "by"))]
        return box(F.least(*corners[:2]), F.least(*corners[2:]), F.greatest(*corners[:2]), F.greatest(*corners[2:]))

    return with_value(with_value(page, base), placed)


def luma_hex(hue: Column, saturation: float, lightness: float) -> Column:
    """A colour of the wheel as ``RRGGBB``."""
    chroma = (1 - abs(2 * lightness - 1)) * saturation
    sector = F.pmod(hue, F.lit(360)) / 60.0
    x = chroma * (1 - F.abs(F.pmod(sector, F.lit(2.0)) - 1))
    m, zero, c = lightness - chroma / 2, F.lit(0.0), F.lit(chroma)
    pick = lambda *six: F.when(sector < 1, six[0]).when(sector < 2, six[1]).when(sector < 3, six[2]).when(sector < 4, six[3]).when(sector < 5, six[4]).otherwise(six[5])
    parts = (pick(c, x, zero, zero, x, c), pick(x, c, c, x, zero, zero), pick(zero, zero, x, c, c, x))
    return F.concat(*[F.lpad(F.hex(F.round((p + m) * 255).cast("int")), 2, "0") for p in parts])


def lightened(hex_colour: Column, factor: float) -> Column:
    """A ``RRGGBB`` colour moved towards white by the factor."""
    channel = lambda i: F.conv(F.substring(hex_colour, i, 2), 16, 10).cast("int")
    return F.concat(*[F.lpad(F.hex(F.floor(channel(i) + (255 - channel(i)) * factor).cast("int")), 2, "0") for i in (1, 3, 5)])


def series_colour(name: Column, fixed: dict[str, str], saturation: float = 0.55, lightness: float = 0.5) -> Column:
    """A fixed colour for a known category, else one from a hash that is the same in every run."""
    table = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv])
    low = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(table, low), luma_hex(F.pmod(F.xxhash64(low), F.lit(360)), saturation, lightness))
