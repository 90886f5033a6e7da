"""Text normalisation shared by routing, casting and null handling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character Python's str.strip() removes, derived from the Unicode rule.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(c: Column) -> Column:
    """Trim all leading and trailing whitespace, not only spaces."""
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def match_key(c: Column, case_sensitive: bool, trim: bool) -> Column:
    """The form of a cell that value lists are compared with."""
    text = c.cast("string")
    if case_sensitive:
        return text
    return F.lower(strip(text) if trim else text)


def safe_label(c: Column) -> Column:
    """Replace characters that are not safe in a file or partition name."""
    return F.regexp_replace(c.cast("string"), r'[\\/:*?"<>|\s]', "_")
