"""Boolean checks as column expressions. Every one gives true or false, never null."""

from functools import reduce
from string import ascii_uppercase

from pyspark.sql import Column, functions as F

from docproof.functions.reference_data import CURRENCIES, IBAN_LENGTHS
from docproof.functions.text import (
    WS,
    clean_account,
    is_absent,
    is_present,
    normalize_text,
)

# ---------------------------------------------------------------- source text

def has_text_layer(raw_text: Column) -> Column:
    return F.coalesce(raw_text.rlike(f"[^{WS}]"), F.lit(False))


# Longer values skip the pattern and go straight to comparing normalized texts.
MAX_PATTERN_LENGTH = 256
# Whitespace of the ASCII range and the no-break space; rarer ones are left to normalization.
# Kept short: spelling the pattern out per row costs more than searching with it.
_GAP = r"[\s\x1c-\x1f\xa0,./-]*+"


def _spelled(normalized: Column) -> Column:
    """Pattern for a normalized value with whitespace and ignored punctuation anywhere inside."""
    literal = F.regexp_replace(normalized, r"([^\p{L}\p{Nd}])", r"\\$1")
    spaced = F.regexp_replace(literal, r"(?s)\\?.", "$0" + _GAP.replace("\\", r"\\"))
    return F.concat(F.lit("(?i)"), spaced)


def quick_grounding(value: Column, raw_text: Column) -> Column:
    """Grounding decided without normalizing the text; null where that is still needed.

    Verbatim text is by far the most common case and a plain search, and so is text that only has
    other blanks. Otherwise the value's characters are searched with gaps between them, which is
    about five times cheaper than normalizing a page. A failed search is final when the text is all
    ASCII; other alphabets may still match after upper-casing.
    """
    normalized = normalize_text(value)
    short = F.length(normalized) <= MAX_PATTERN_LENGTH
    ascii_text = F.octet_length(raw_text) == F.length(raw_text)
    return (
        F.when(is_absent(value) | is_absent(raw_text), False)
        .when(F.contains(raw_text, value), True)
        .when(F.contains(F.replace(raw_text, F.lit(" ")), F.replace(value, F.lit(" "))), True)
        .when(normalized == "", True)
        .when(short & F.rlike(raw_text, _spelled(normalized)), True)
        .when(short & ascii_text, False)
    )


def is_grounded(value: Column, raw_text: Column) -> Column:
    """Whether a value occurs in the text, whatever the layout and case of both."""
    return F.coalesce(
        quick_grounding(value, raw_text),
        F.contains(normalize_text(raw_text), normalize_text(value)),
    )


def cents_digits(cents: Column) -> Column:
    """All digits of an amount in cents, without leading zeros (``0.05`` → ``5``)."""
    digits = F.replace(F.abs(cents).cast("string"), F.lit("."))
    return F.regexp_replace(digits, r"\A0+(?=[0-9])", "")


def whole_and_cents(cents: Column, strict_cents: bool = False) -> tuple[Column, Column]:
    """Digits before and after the decimal mark, as they are searched for.

    Amounts below 0.10 lose the zero after the mark (0.05 is searched as ``0.5``), and so do
    the rules built on this; ``strict_cents`` searches for both digits.
    """
    digits = cents_digits(cents)
    if strict_cents:
        digits = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    whole = F.when(F.length(digits) > 2, F.left(digits, F.length(digits) - 2)).otherwise("0")
    return whole, F.right(digits, F.lit(2))


# With (?U), \s and \d cover Unicode; \s then lacks only the four ASCII separators.
_DIGIT_GAP = r"[\s\x1c-\x1f.,_]*+"
_MARK = r"[\s\x1c-\x1f_]*+[.,][\s\x1c-\x1f_]*+"


def is_amount_grounded(cents: Column, raw_text: Column, strict_cents: bool = False) -> Column:
    """Whether an amount rounded to cents is printed in the text.

    Runs of whitespace, marks and underscores may separate its integer digits, the cents stand
    together after one decimal mark, and no other digit touches either end.
    """
    whole, fraction = whole_and_cents(cents, strict_cents)
    pattern = F.concat(
        F.lit(r"(?U)(?<!\d)"),
        F.regexp_replace(whole, "([0-9])(?=[0-9])", "$1" + _DIGIT_GAP.replace("\\", r"\\")),
        F.lit(_MARK),
        fraction,
        F.lit(r"(?!\d)"),
    )
    return F.coalesce(F.rlike(raw_text, pattern), F.lit(False))


# ---------------------------------------------------------------- bank accounts

# Python's $ also matches before a closing line feed, so a shape check accepts one.
IBAN_SHAPE = r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\n?\z"


def _remainder_97(digits: Column) -> Column:
    """Remainder of a number of up to 72 digits, from four pieces that fit a bigint each."""
    padded = F.lpad(digits, 72, "0")
    weighted = [
        F.substring(padded, 18 * i + 1, 18).try_cast("bigint") % 97 * (10 ** (18 * (3 - i)) % 97)
        for i in range(4)
    ]
    return reduce(Column.__add__, weighted) % 97


def _letters_as_numbers(c: Column) -> Column:
    """A becomes 10, B 11, … Z 35."""
    return reduce(
        lambda acc, letter: F.replace(acc, F.lit(letter), F.lit(str(ord(letter) - 55))),
        ascii_uppercase,
        c,
    )


def one_of(c: Column, values) -> Column:
    """Membership in a fixed list of codes, which travels as one literal."""
    return F.coalesce(F.find_in_set(c, F.lit(",".join(values))) > 0, F.lit(False))


def _length_ok(cleaned: Column, lengths: dict[str, int]) -> Column:
    """Unlisted country, or the length its country asks for."""
    country = F.left(cleaned, F.lit(2))
    listed = [f"{code}{length}" for code, length in lengths.items()]
    return ~one_of(country, lengths) | one_of(F.concat(country, F.length(cleaned).cast("string")), listed)


def is_iban_like(account: Column) -> Column:
    return F.coalesce(clean_account(account).rlike(IBAN_SHAPE), F.lit(False))


def iban_digits(account: Column, lengths: dict[str, int] = IBAN_LENGTHS) -> Column:
    """The digits the checksum runs over; null where shape or length already fail.

    The country code moves behind the account. Most countries' accounts are digits only, so the
    two country letters are usually all there is to turn into numbers.
    """
    cleaned = clean_account(account)
    bban, check = F.substr(cleaned, F.lit(5)), F.substring(cleaned, 3, 2)
    first, second = F.substring(cleaned, 1, 1), F.substring(cleaned, 2, 1)
    numeric = F.concat(bban, (F.ascii(first) - 55).cast("string"), (F.ascii(second) - 55).cast("string"), check)
    mixed = _letters_as_numbers(F.concat(bban, first, second, check))
    candidate = is_iban_like(account) & ~cleaned.endswith("\n") & _length_ok(cleaned, lengths)
    return F.when(candidate, F.when(bban.rlike("[A-Z]"), mixed).otherwise(numeric))


def is_checksum_ok(digits: Column) -> Column:
    return F.coalesce(_remainder_97(digits) == 1, F.lit(False))


def is_valid_iban(account: Column, lengths: dict[str, int] = IBAN_LENGTHS) -> Column:
    """Shape, length for the country when listed, and the mod-97 check."""
    return is_checksum_ok(iban_digits(account, lengths))


def iban_check_fails(account: Column, lengths: dict[str, int] = IBAN_LENGTHS) -> Column:
    """An account that reaches the checksum with a closing line feed cannot be computed."""
    cleaned = clean_account(account)
    return F.coalesce(
        is_iban_like(account) & cleaned.endswith("\n") & _length_ok(cleaned, lengths),
        F.lit(False),
    )


def lookup_country_length(account: Column, lengths: dict[str, int] = IBAN_LENGTHS) -> Column:
    """The length an account's country asks for; null when the country is not listed."""
    country = F.left(clean_account(account), F.lit(2))
    table = F.str_to_map(F.lit(",".join(f"{code}:{length}" for code, length in lengths.items())))
    return F.try_element_at(table, country).cast("int")


def is_known_iban_country(account: Column, lengths: dict[str, int] = IBAN_LENGTHS) -> Column:
    return one_of(F.left(clean_account(account), F.lit(2)), lengths)


# ---------------------------------------------------------------- currency and dates

def is_valid_currency_code(currency: Column, currencies=CURRENCIES) -> Column:
    """Exact match, upper case only."""
    return one_of(currency, sorted(currencies))


def is_issue_date_plausible(issue_date: Column, ref_date: Column) -> Column:
    return F.coalesce(issue_date <= ref_date, F.lit(False))


def is_payment_after_issue(issue_date: Column, payment_date: Column) -> Column:
    return F.coalesce(payment_date >= issue_date, F.lit(True))


def is_payment_consistent(issue_date: Column, payment_date: Column, days: Column) -> Column:
    """True unless both are known and differ. Counted in bigint days, which cannot overflow a date."""
    due = F.try_add(F.unix_date(issue_date).cast("bigint"), days)
    return F.coalesce(F.unix_date(payment_date) == due, F.lit(True))


# Longest day count, and the days of 0001-01-01 and 9999-12-31.
MAX_DAYS = 999_999_999
FIRST_DAY = -719_162
LAST_DAY = 2_932_896


def due_date_overflows(
    issue_date: Column, payment_date: Column, days: Column, days_readable: Column
) -> Column:
    """Whether issue date plus terms leaves the calendar (only looked at with both dates known)."""
    due = F.unix_date(issue_date) + days
    outside = F.when(days.between(-MAX_DAYS, MAX_DAYS), ~due.between(FIRST_DAY, LAST_DAY)).otherwise(True)
    return F.coalesce(
        issue_date.isNotNull() & payment_date.isNotNull() & days_readable & outside, F.lit(False)
    )


__all__ = [
    "due_date_overflows",
    "has_text_layer",
    "iban_check_fails",
    "is_absent",
    "is_amount_grounded",
    "is_grounded",
    "is_iban_like",
    "is_issue_date_plausible",
    "is_known_iban_country",
    "is_payment_after_issue",
    "is_payment_consistent",
    "is_present",
    "is_valid_currency_code",
    "is_valid_iban",
    "lookup_country_length",
    "quick_grounding",
]
