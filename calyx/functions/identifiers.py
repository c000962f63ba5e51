"""Identifiers, names, addresses and labels in canonical form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from calyx.functions.numbers import part

_DASHES = "—–_"


def squeeze(text: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _joined(text: Column) -> Column:
    s = F.regexp_replace(F.translate(F.trim(text), _DASHES, "---"), r"(?U)\s+", "-")
    return F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), "^-+|-+$", "")


def sample_id(raw: Column) -> Column:
    """``1-d0-A`` as ``001-D0-a``: dashes unified, three parts, misread characters repaired.

    Null and blank give an empty text; fewer than three parts stay as they are.
    """
    s = _joined(F.coalesce(raw, F.lit("")))
    parts = F.filter(F.split(s, "-"), lambda p: p != "")
    first = F.translate(F.get(parts, F.lit(0)), "OoIl", "0011")
    padded = F.when(first.rlike(r"^\d+$"), F.lpad(first, F.greatest(F.length(first), F.lit(3)), F.lit("0"))).otherwise(first)
    second = F.translate(F.upper(F.get(parts, F.lit(1))), "OIL", "011")
    return F.when(F.size(parts) >= 3, F.concat_ws("-", padded, second, F.lower(F.get(parts, F.lit(2))))).otherwise(s)


def scanned_sample_id(raw: Column) -> Column:
    """The weaker form for scanned lines: no padding, only ``MI``/``Ml`` and O for 0 repaired."""
    s = _joined(F.coalesce(raw, F.lit("")))
    parts = F.split(s, "-")
    second = F.regexp_replace(F.get(parts, F.lit(1)), "(?i)^M[Il]$", "M1")
    second = F.regexp_replace(second, r"(?i)^M[Il](\d+)$", "M1$1")
    first = F.get(parts, F.lit(0))
    first = F.when(first.rlike(r"\d"), F.translate(first, "Oo", "00")).otherwise(first)
    return F.when(F.size(parts) >= 3, F.concat_ws("-", first, second, F.get(parts, F.lit(2)))).otherwise(s)


#: The markers in output order; each is also its own alias in lower case.
MARKERS = ("Anti-HBs", "HBsAg", "Anti-HBc", "Anti-HBe", "HBeAg")
_MARKER_ORDER = ("Anti-HBe", "HBeAg", "HBsAg", "Anti-HBc", "Anti-HBs")


def marker(cell: Column) -> Column:
    """The marker a header names, with or without its dash; null if none."""
    s = F.replace(F.lower(F.trim(cell)), F.lit(" "), F.lit(""))
    found = F.lit(None).cast("string")
    for name in reversed(_MARKER_ORDER):
        low = name.lower()
        hit = s.contains(low) | s.contains(low.replace("-", ""))
        found = F.when(hit, F.lit(name)).otherwise(found)
    return found


def is_note(cell: Column) -> Column:
    """A note: a known word, or up to four Han characters."""
    t = F.trim(F.coalesce(cell, F.lit("")))
    return t.isin("阴性", "阳性", "反应", "可疑", "待查") | ((F.char_length(t) <= 4) & t.rlike("^[一-鿿]+$"))


def series_key(title: Column) -> Column:
    """A series title without bracketed parts and without a closing metric."""
    s = F.regexp_replace(F.lower(F.trim(title)), r"[（(][^）)]*[）)]", "")
    return F.trim(F.regexp_replace(s, r"\s*(?:gmc|gmt|gmi|rate|率)\s*$", ""))


def natural_key(text: Column) -> Column:
    """A sort key in which runs of digits order as numbers and letters ignore case.

    Digit runs are padded to twenty places; longer ones order after them by length.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\d+|\D+"), F.lit(0))
    digits = lambda r: F.regexp_replace(r, "^0+(?=.)", "")
    padded = lambda r: F.lpad(digits(r), F.greatest(F.length(digits(r)), F.lit(20)), F.lit("0"))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), padded(r)).otherwise(r)), "")


def safe_name(label: Column, limit: int = 80, default: str = "report") -> Column:
    """A name fit for a file: odd characters as underscores, cut, never empty."""
    s = F.regexp_replace(F.regexp_replace(F.trim(label), r"[^\p{L}\p{N}._-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.when(s != "", F.left(s, F.lit(limit))), F.lit(default))


def masked(secret: Column, head: int = 4, tail: int = 4) -> Column:
    """All but the ends hidden; a short secret is hidden wholly."""
    n = F.length(secret)
    hidden = F.concat(F.left(secret, F.lit(head)), F.repeat(F.lit("*"), n - head - tail), F.right(secret, F.lit(tail)))
    return F.when(n <= head + tail, F.repeat(F.lit("*"), n)).otherwise(hidden)


def han_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[一-鿿]"))


def is_translated(source: Column, target: Column) -> Column:
    """A usable translation: not blank, changed, and not only ASCII."""
    good = (F.trim(target) != "") & (F.trim(source) != F.trim(target)) & target.rlike(r"[^\x00-\x7F]")
    return F.coalesce(good, F.lit(False))


def name_token(value: Column) -> Column:
    """A font name without its subset prefix, in lower case, without dashes and blanks."""
    return F.regexp_replace(F.lower(F.regexp_replace(value, "^[A-Z]{6}\\+", "")), "[-\\s_]+", "")


def part_number(file_name: Column) -> Column:
    """The part a file name gives: ``part 3`` or ``第3部分`` first, else its first number."""
    named = F.coalesce(part(file_name, r"(?i)part[\s_-]*(\d+)", 1), part(file_name, r"第\s*(\d+)\s*部分", 1))
    return F.coalesce(named, part(file_name, r"(\d+)", 1)).try_cast("int")


def column_number(letters: Column) -> Column:
    """``AA`` as 27."""
    signs = F.split(F.upper(letters), "")
    return F.aggregate(F.filter(signs, lambda c: c != ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)


def cell_address(address: Column) -> Column:
    """``B3`` as (row, col); null where the text is no address."""
    pattern = r"^\s*\$?([A-Za-z]{1,3})\$?([1-9]\d*)\s*$"
    letters, row = part(address, pattern, 1), part(address, pattern, 2).try_cast("int")
    return F.when(letters.isNotNull() & row.isNotNull(), F.struct(row.alias("row"), column_number(letters).alias("col")))


def cell_range(reference: Column) -> Column:
    """``'Sheet 1'!$A$2:$B$10`` as (sheet, min_row, max_row, min_col, max_col); one cell is a range too."""
    pattern = r"^'?([^'!]+)'?!\$?([A-Z]{1,3})\$?(\d+)(?::\$?([A-Z]{1,3})\$?(\d+))?$"
    sheet, c1, r1, c2, r2 = (part(reference, pattern, g) for g in range(1, 6))
    col1, row1 = column_number(c1), r1.try_cast("int")
    col2, row2 = F.coalesce(column_number(c2), col1), F.coalesce(r2.try_cast("int"), row1)
    out = F.struct(
        sheet.alias("sheet"), F.least(row1, row2).alias("min_row"), F.greatest(row1, row2).alias("max_row"),
        F.least(col1, col2).alias("min_col"), F.greatest(col1, col2).alias("max_col"),
    )
    return F.when(sheet.isNotNull(), out)


def column_letters(number: Column) -> Column:
    """27 as ``AA``, up to three letters."""
    n = number - 1
    sign = lambda i: F.chr(F.pmod(i, F.lit(26)) + 65)
    two, three = F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    return F.concat(F.when(three >= 0, sign(three)).otherwise(""), F.when(two >= 0, sign(two)).otherwise(""), sign(n))


def query_kind(text: Column) -> Column:
    """doi, pmid, url or title."""
    s = F.trim(text)
    return (
        F.when(s.rlike(r"(?i)^(?:doi:\s*)?10\.\d{4,9}/\S+$"), "doi").when(s.rlike(r"^(?:(?i)pmid:?\s*)?\d{6,9}$"), "pmid")
        .when(s.rlike(r"(?i)^https?://"), "url").otherwise("title")
    )


def doi_of(text: Column) -> Column:
    """The DOI in a link or text, its lost ``10`` put back; else null."""
    s = F.trim(text)
    return F.coalesce(
        part(s, r"(10\.\d{4,9}/[^\s?#]+)", 1),
        F.when(s.rlike(r"^\.\d{4,9}/\S+$"), F.concat(F.lit("10"), s)),
    )


def pmid_of(text: Column) -> Column:
    return F.coalesce(part(text, r"(?i)pubmed[^\s]*?/(\d{6,9})", 1), part(text, r"(?i)^\s*(?:pmid:?\s*)?(\d{6,9})\s*$", 1))


#: How a link can be harmful.
SCRIPT_SCHEMES = ("javascript:", "vbscript:", "data:text/html", "file:")


def url_risk(url: Column) -> Column:
    """script, scheme, or ok: script text anywhere outranks a bad scheme."""
    s = F.lower(F.trim(url))
    scheme = F.lit(False)
    for prefix in SCRIPT_SCHEMES:
        scheme = scheme | s.startswith(prefix)
    return F.when(s.contains("<script") | s.contains("javascript:"), "script").when(scheme, "scheme").otherwise("ok")


def first_pdf_link(html: Column, base: Column) -> Column:
    """The first PDF a page links to (href, else src), resolved against its address."""
    link = F.coalesce(
        part(html, r"""(?i)href=["']([^"']+\.pdf(?:\?[^"']*)?)["']""", 1), part(html, r"""(?i)src=["']([^"']+\.pdf(?:\?[^"']*)?)["']""", 1)
    )
    root, folder = part(base, r"^(\w+://[^/]+)", 1), part(base, r"^(\w+://[^/]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link.rlike(r"^\w+://"), link).when(link.startswith("//"), F.concat(part(base, r"^(\w+:)", 1), link))
        .when(link.startswith("/"), F.concat(root, link)).when(link.isNotNull(), F.concat(folder, link))
    )


def egress_risk(proxy: Column, resolver: Column) -> Column:
    """Whether the resolver's country gives the proxy away."""
    p, r = F.lower(F.trim(proxy)), F.lower(F.trim(resolver))
    unknown = F.coalesce((p == "") | (r == ""), F.lit(True))
    return F.when(unknown, "unknown").when(p.contains(r) | r.contains(p), "low").otherwise("high")


def device_role(ip: Column, gateway: Column, local: Column, ports: Column) -> Column:
    """What a device is, from its address and its open ports; the first rule that fits."""
    has = lambda *n: F.arrays_overlap(F.coalesce(ports, F.array().cast("array<int>")), F.array(*[F.lit(x) for x in n]))
    return (
        F.when(ip == gateway, "router").when(ip == local, "this device").when(has(9100, 631, 515), "printer")
        .when(has(554), "camera").when(has(445, 139), "file server").when(has(80, 443), "web device").when(has(22), "ssh host")
        .otherwise("unknown")
    )


def ip_number(ip: Column) -> Column:
    """An address as a number; null if it is none."""
    p = F.split(ip, r"\.")
    octet = lambda i: F.get(p, F.lit(i)).try_cast("long")
    fine = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    return F.when(fine, octet(0) * 16777216 + octet(1) * 65536 + octet(2) * 256 + octet(3))


def is_private_ip(ip: Column) -> Column:
    n = ip_number(ip)
    block = lambda lo, hi: (n >= lo) & (n <= hi)
    return F.coalesce(block(167772160, 184549375) | block(2886729728, 2887778303) | block(3232235520, 3232301055), F.lit(False))


def is_unicast_mac(mac: Column) -> Column:
    """Neither broadcast, nor multicast, nor empty."""
    s = F.lower(F.translate(F.trim(mac), "-", ":"))
    first = F.conv(F.substring(s, 1, 2), 16, 10).try_cast("int")
    return F.coalesce((s != "ff:ff:ff:ff:ff:ff") & (s != "00:00:00:00:00:00") & (first % 2 == 0), F.lit(False))


def link_fault(kind: Column, uri: Column, target: Column) -> Column:
    """Why a link may not stay in a submission; null if it may."""
    s = F.lower(F.trim(F.coalesce(uri, F.lit(""))))
    return (
        F.when(kind == "launch", "launches a program").when(kind == "uri", F.when(s.startswith("javascript:"), "script")
        .when(s.rlike("^https?://"), "external address").when(s.startswith("mailto:"), "mail address").otherwise("unknown address"))
        .when((kind == "gotor") & target.rlike(r"^[A-Za-z]:|^/|^\\\\"), "absolute path")
    )


def named_by(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str | None = None) -> Column:
    """The first class one of whose words the text contains, ignoring case."""
    s, out = F.lower(text), F.lit(default).cast("string")
    for name, words in reversed(list(rules)):
        hit = F.lit(False)
        for w in words:
            hit = hit | s.contains(w.lower())
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def mapped(value: Column, table: Mapping[str, str]) -> Column:
    """A value by a small fixed table; null where it is not in it."""
    if not table:
        return F.lit(None).cast("string")
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.when(value.isin(list(table)), pairs[value])
