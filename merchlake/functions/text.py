"""Text column functions: cleaning, slugs, numbers in free text, tokens, snippets, hashes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def lowered(*texts: Column) -> Column:
    """The texts in lower case with spaces between; nulls count as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]))


def has_any(text: Column, needles: list[str]) -> Column:
    """Whether any needle is a substring; false for null. One pattern for all, so the text is made once and plans stay small."""
    return F.coalesce(text.rlike("|".join(re.escape(n) for n in needles)), F.lit(False))


def flag_count(text: Column, patterns: list[str]) -> Column:
    """How many patterns match somewhere, whatever the case; 0 for null."""
    hits = [F.coalesce(text.rlike(f"(?i){p}"), F.lit(False)).cast("int") for p in patterns]
    return reduce(lambda a, b: a + b, hits)


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null if none."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def ladder(steps: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first step whose condition holds."""
    out = None
    for condition, value in steps:
        value = F.lit(value) if not isinstance(value, Column) else value
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def squeeze(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slugify(text: Column, joint: str = "-", default: str | None = None) -> Column:
    """Lower-case letters and digits with `joint` between runs of anything else."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", joint), f"^{joint}+|{joint}+$", "")
    return slug if default is None else F.when(slug == "", F.lit(default)).otherwise(F.substring(slug, 1, 255))


def digits(text: Column) -> Column:
    """All digits of a price text as one number, decimals included; null if none."""
    return F.regexp_replace(text, r"\D", "").try_cast("long")


# numbers in free text: patterns are fixed values, in Java's syntax
MAH = r"(?i)(\d{2,5})\s*mAh"
WATT = r"(?i)(\d{1,3}(?:\.\d+)?)\s*W(?!\w)"
RAM_NAMED = r"(?i)(\d{1,3})\s*GB(?:\s+RAM|\s*RAM|\s+LPDDR)"
RAM_BARE = r"(?i)\b(\d{1,2})\s*GB\b"
INCHES = r"(?i)(\d\.\d{1,2})\s*-?\s*inch"
HERTZ = r"(?i)(\d{2,3})\s*Hz"
MEGAPIXELS = r"(?i)(\d{1,3})\s*MP"
NITS = r"(?i)(\d{3,5})\s*nits"


def mah(text: Column) -> Column:
    return first_match(text, MAH).cast("int")


def watt(text: Column) -> Column:
    return F.floor(first_match(text, WATT).cast("double")).cast("int")


def ram_gb(text: Column) -> Column:
    return F.coalesce(first_match(text, RAM_NAMED), first_match(text, RAM_BARE)).cast("int")


def inches(text: Column) -> Column:
    return first_match(text, INCHES).cast("double")


def hertz(text: Column) -> Column:
    return first_match(text, HERTZ).cast("int")


def largest(text: Column, pattern: str) -> Column:
    """The largest of all numbers that group 1 of the pattern finds."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: n.cast("int")))


def megapixels(text: Column) -> Column:
    return largest(text, MEGAPIXELS)


def nits(text: Column) -> Column:
    return largest(text, NITS)


TOKEN = r"[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)*"


def tokens(text: Column) -> Column:
    """Lower-case tokens of more than one character: letters and digits, joined by -, _ or /."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) > 1)


def token_hash(token: Column, seed: int = 0) -> Column:
    """A stable 32-bit hash: the first eight hex digits of the sha1 of seed:token."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), token).cast("binary")), 1, 8), 16, 10).cast("long")


def snippet(text: Column, most: int = 280) -> Column:
    """The squeezed text, cut at the last space within `most` characters, with an ellipsis if cut."""
    flat = squeeze(text)
    head = F.rtrim(F.regexp_replace(F.substring(flat, 1, most), r"\s\S*$", ""))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(head, F.lit("…")))


def first_sentence(text: Column, most: int = 140) -> Column:
    """Up to the first full stop, question or exclamation mark before white space; cut with an ellipsis."""
    flat = squeeze(text)
    first = F.coalesce(first_match(flat, r"^(.*?[.!?])\s"), flat)
    return F.when(F.length(first) <= most, first).otherwise(F.concat(F.rtrim(F.substring(first, 1, most - 1)), F.lit("…")))


def strip_html(html: Column) -> Column:
    """Text of HTML: scripts, styles and comments go, block tags become spaces, the commonest entities are read."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|nav|article|section)\b[^>]*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return squeeze(t)
