"""Text helpers: Unicode whitespace, normalization for comparison, digits."""

import sys
import unicodedata

from pyspark.sql import Column, functions as F

# Inside a regex character class: every character Python's str.strip() and \s treat as
# whitespace. Java's own \s and Spark's trim() know only the ASCII ones.
WS = (
    r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS_CHARS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())

# Punctuation that comparison ignores, besides whitespace.
IGNORED = ",.-/"

# Decimal digits outside ASCII and the ASCII digit each one stands for.
_FOREIGN = [
    c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"
]
_FOREIGN_DIGITS = "".join(_FOREIGN)
_FOREIGN_VALUES = "".join(str(unicodedata.decimal(c)) for c in _FOREIGN)


def is_absent(c: Column) -> Column:
    """Null or the empty string. Blanks count as present."""
    return c.isNull() | (c == "")


def is_present(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def strip(c: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.regexp_replace(c, rf"\A[{WS}]+|[{WS}]+\z", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def normalize_text(c: Column) -> Column:
    """Drop whitespace and ``, . - /`` and upper-case, so that layout does not matter.

    ``translate`` does this about three times as fast as a regex replacement.
    """
    return F.upper(F.translate(c, WS_CHARS + IGNORED, ""))


def clean_account(c: Column) -> Column:
    """Drop ASCII blanks (only those) and upper-case."""
    return F.upper(F.replace(c, F.lit(" ")))


def ascii_digits(c: Column) -> Column:
    """Turn other scripts' decimal digits into ASCII ones."""
    return F.when(
        c.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(c, _FOREIGN_DIGITS, _FOREIGN_VALUES)
    ).otherwise(c)
