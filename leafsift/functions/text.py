"""Text column functions whose regexes follow Unicode the way the metric rules expect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java spelling of the Unicode classes: white space, not white space, not a word character.
SPACE = r"(?U)[\s\x1c-\x1f]"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_regex(text: str) -> str:
    """Escape ``text`` for Java regexes and RE2 alike."""
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}-" else ch for ch in text)


def count_matches(text: Column | str, pattern: str) -> Column:
    """Number of non-overlapping matches."""
    return F.regexp_count(col(text), F.lit(pattern))


def strip(text: Column | str) -> Column:
    """Trim Unicode white space at both ends."""
    edge = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
    return F.regexp_replace(col(text), edge, "")


def is_blank(text: Column | str) -> Column:
    """True for a non-empty string of white space only."""
    return col(text).rlike(r"(?U)\A[\s\x1c-\x1f]+\z")


def squash(text: Column | str) -> Column:
    """White-space runs to one space, then anything outside printable ASCII to a space."""
    return F.regexp_replace(F.regexp_replace(col(text), SPACE + "+", " "), r"[^ -~]", " ")


def round_significant(x: Column | str, digits: int = 2) -> Column:
    """Half-even rounding to ``digits`` significant figures; null for zero."""
    x = col(x).cast("double")
    places = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), places.cast("double"))
    return F.when(x != 0, F.bround(x * scale) / scale)


def mask_numbers(text: Column | str, years: bool = True) -> Column:
    """A text that is just a year becomes YEAR; other numbers (and percentages) become NUM."""
    out = col(text)
    if years:
        out = F.regexp_replace(out, r"(?U)^(19|20)\d{2}(?=\n?\z)", "YEAR")
    return F.regexp_replace(out, r"(?U)\d+(\.\d+)?(%)?", "NUM")
