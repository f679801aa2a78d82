"""Text columns: keys, sanitising, categories, versions, URLs and clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: variants of one source lie this far apart.
SLOTS = 100


def name_key(name: Column) -> Column:
    """Lower case, an ampersand as a word, everything but a-z and 0-9 as single spaces."""
    spelled = F.replace(F.lower(name), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))


def one_line(text: Column, most: int) -> Column:
    """No control or invisible characters, single spaces, trimmed, cut."""
    shown = F.regexp_replace(text, r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{00AD}]", "")
    flat = F.regexp_replace(shown, r"[\x00-\x20\x{7F}-\x{A0}]+", " ")
    return F.substring(F.trim(flat), 1, most)


def clean_lines(text: Column) -> Column:
    """Line ends as line feeds, trimmed; null where nothing is left."""
    return F.nullif(F.btrim(F.regexp_replace(text, "\r\n?", "\n"), F.lit(" \t\n\x0b\x0c\r")), F.lit(""))


def markdown_safe(text: Column) -> Column:
    """Characters with a meaning in Markdown get a backslash."""
    return F.regexp_replace(text, r"([\\`*_{}\[\]()<>#+.!|~-])", r"\\$1")


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss under an hour."""
    s = F.floor(seconds)
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(rest))).otherwise(F.concat_ws(":", m.cast("string"), two(rest)))


def version_parts(version: Column) -> Column:
    """Four whole numbers of a version of one to four parts, null for anything else."""
    parts = F.transform(F.split(version, r"\."), lambda x: x.cast("int"))
    padded = F.slice(F.concat(parts, F.array(*[F.lit(0)] * 4)), 1, 4)
    return F.when(version.rlike(r"^\d{1,9}(\.\d{1,9}){0,3}$"), padded)


def is_newer(version: Column, than: Column) -> Column:
    """1.10 is newer than 1.9; missing parts are 0; anything but a version is never newer."""
    return F.coalesce(version_parts(version) > version_parts(than), F.lit(False))


def canonical_url(url: Column) -> Column:
    """http(s) without query, fragment and trailing slash, host in lower case; null with credentials or another scheme."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    good = scheme.isin("http", "https") & (authority != "") & ~authority.contains("@")
    return F.when(good, F.concat(scheme, F.lit("://"), F.lower(authority), F.regexp_replace(path, "/+$", "")))


def first_category(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The category of the first pattern that matches."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def first_tag(tags: Column, priority: list[str], default: str) -> Column:
    """The first of the priority list that is among the tags."""
    known = F.filter(F.array(*[F.lit(p) for p in priority]), lambda t: F.array_contains(tags, t))
    return F.coalesce(F.get(known, F.lit(0)), F.lit(default))


def positive_price(text: Column) -> Column:
    """A price string as a positive double, else null."""
    price = text.try_cast("double")
    return F.when(price > 0, price)


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def folded_angle(degrees: Column) -> Column:
    """An axis angle in (-90, 90]."""
    turned = F.pmod(degrees, F.lit(180))
    return F.when(turned > 90, turned - 180).otherwise(turned)


def synthetic_id(source_id: Column, variant: Column) -> Column:
    """Negative ids for variants 1 to 99 of an outer source with a positive id: 100 for each source row; else null."""
    return F.when((source_id >= 1) & variant.between(1, SLOTS - 1), -(source_id * SLOTS + variant))


def is_synthetic(item_id: Column) -> Column:
    """From -101 down, so the sentinel -1 is not one."""
    return (item_id <= -(SLOTS + 1)) & (F.pmod(-item_id, F.lit(SLOTS)) != 0)


def synthetic_parts(item_id: Column) -> Column:
    """(source_id, variant) of a synthetic id, null for others."""
    parts = F.struct(F.floor(-item_id / SLOTS).alias("source_id"), F.pmod(-item_id, F.lit(SLOTS)).alias("variant"))
    return F.when(is_synthetic(item_id), parts)
