"""Typed values from captured strings. Absent or unreadable input gives null; nothing throws.

What is readable follows the Python standard library: ``date.fromisoformat``, ``Decimal``, ``int``.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from docproof.functions.text import WS, ascii_digits, strip

CALENDAR_DATE = r"\A(?!0000)[0-9]{4}(-?)[0-9]{2}\1[0-9]{2}\z"
WEEK_DATE = r"\A(?!0000)([0-9]{4})(-?)W(0[1-9]|[1-4][0-9]|5[0-3])(?:\2([1-7]))?\z"


def parse_iso_date(c: Column) -> Column:
    """``2026-06-01``, ``20260601``, ``2026-W23-1``, ``2026W231`` and the week forms without a day."""
    digits = F.replace(c, F.lit("-"))
    dashed = F.concat_ws(
        "-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)
    )
    year = F.regexp_extract(c, WEEK_DATE, 1).try_cast("int")
    week = F.regexp_extract(c, WEEK_DATE, 3).try_cast("int")
    day = F.coalesce(F.regexp_extract(c, WEEK_DATE, 4).try_cast("int"), F.lit(1))
    monday_of_week_1 = F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date")
    by_week = F.date_add(monday_of_week_1, (week - 1) * 7 + day - 1)
    week_ok = (F.extract(F.lit("yearofweek"), by_week) == year) & F.year(by_week).between(1, 9999)
    return F.when(c.rlike(CALENDAR_DATE), dashed.try_cast("date")).when(
        c.rlike(WEEK_DATE), F.when(week_ok, by_week)
    )


# ---------------------------------------------------------------- amounts

NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?0*[0-9]{1,18})?\z"
NOT_FINITE = r"\A[+-]?(?i:inf|infinity|s?nan[0-9]*)\z"
AMOUNT = r"\A[+-]?([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?\z"
# Fixed value: rounding to cents works on 28 digits, 26 of them before the point.
MAX_INTEGER_DIGITS = 26


def bare_amount(c: Column) -> Column:
    """Amount text without outer whitespace and without underscores."""
    return F.when(c.rlike(r"\A[0-9]+\.[0-9]{2}\z"), c).otherwise(
        F.replace(strip(ascii_digits(c)), F.lit("_"))
    )


def is_amount_syntax(bare: Column) -> Column:
    """Whether bare text reads as a number, including NaN and infinities."""
    return bare.rlike(NUMBER) | bare.rlike(NOT_FINITE)


def plain_amount(bare: Column) -> Column:
    """Bare text with any exponent worked in (``1.5E3`` → ``1500.``); null for no finite number.

    Zeros are padded no further than decides the value.
    """
    whole = F.regexp_extract(bare, AMOUNT, 1)
    fraction = F.regexp_extract(bare, AMOUNT, 2)
    reach = F.length(bare) + 60
    exponent = F.greatest(
        F.least(F.regexp_extract(bare, AMOUNT, 3).try_cast("bigint"), reach), -reach
    ).cast("int")
    padded_left = F.concat(F.repeat(F.lit("0"), -exponent), whole)
    moved_down = F.concat(
        F.left(padded_left, F.length(padded_left) + exponent),
        F.lit("."),
        F.right(padded_left, -exponent),
        fraction,
    )
    padded_right = F.concat(fraction, F.repeat(F.lit("0"), exponent))
    moved_up = F.concat(
        whole, F.left(padded_right, exponent), F.lit("."), F.substr(padded_right, exponent + 1)
    )
    sign = F.when(bare.startswith("-"), "-").otherwise("")
    moved = F.when(exponent < 0, moved_down).otherwise(moved_up)
    return (
        F.when(~bare.rlike(NUMBER), None)
        .when(~bare.rlike("[eE]"), bare)
        .when(~bare.rlike(r"\A[^eE]*[1-9]"), "0")
        .otherwise(F.concat(sign, moved))
    )


def parse_plain_amount(plain: Column) -> Column:
    """Amount as decimal(38,12); null for more than 26 integer digits.

    Digits past the twelfth decimal are folded into the last one when any of them is not zero,
    which keeps the value on its own side of every half cent.
    """
    too_long = plain.rlike(rf"\A[+-]?0*[1-9][0-9]{{{MAX_INTEGER_DIGITS},}}(\.|\z)")
    folded = F.when(
        plain.rlike(r"\.[0-9]{13}"),
        F.regexp_replace(plain, r"(\.[0-9]{11})[0-9]*[1-9][0-9]*\z", "$11"),
    ).otherwise(plain)
    return F.when(~too_long, folded.try_cast("decimal(38,12)"))


def with_amount(df: DataFrame, source: str, target: str = "parsed_amount") -> DataFrame:
    """Add ``<target>`` (decimal(38,12) or null) and ``<target>_readable``.

    The steps are separate projections because each one's result is used several times.
    """
    bare, plain = f"{target}_bare", f"{target}_plain"
    return (
        df.withColumn(bare, bare_amount(F.col(source)))
        .withColumn(plain, plain_amount(F.col(bare)))
        .withColumns(
            {
                f"{target}_readable": F.coalesce(is_amount_syntax(F.col(bare)), F.lit(False)),
                target: parse_plain_amount(F.col(plain)),
            }
        )
        .drop(bare, plain)
    )


def to_cents(amount: Column) -> Column:
    """Round half to even; null where the result needs more than 28 digits."""
    cents = F.bround(amount, 2)
    limit = F.lit(Decimal(10) ** MAX_INTEGER_DIGITS)
    return F.when(F.abs(cents) < limit, cents.cast("decimal(38,2)"))


# ---------------------------------------------------------------- day counts

# int() keeps the four ASCII separators \x1c-\x1f, unlike strip().
_INT_WS = WS.replace(r"\s", r"\t-\r ").replace(r"\x1c-\x1f", "")
WHOLE = rf"\A[{_INT_WS}]*[+-]?[0-9](?:[0-9_]*[0-9])?[{_INT_WS}]*\z"
SHORT_COUNT = r"\A[0-9]{1,9}\z"
# Fixed value: int() refuses longer digit strings.
MAX_INT_DIGITS = 4300


def is_whole_number(c: Column) -> Column:
    """Whether the text reads as an integer of any size."""
    ascii_only = ascii_digits(c)
    few = F.length(F.regexp_replace(ascii_only, "[^0-9]", "")) <= MAX_INT_DIGITS
    single = ~F.contains(ascii_only, F.lit("__"))
    any_form = ascii_only.rlike(WHOLE) & single & ((F.length(c) <= MAX_INT_DIGITS) | few)
    return F.when(c.rlike(SHORT_COUNT), True).otherwise(any_form)


def parse_days(c: Column) -> Column:
    """Whole number as bigint; null where it does not fit."""
    digits = F.regexp_replace(ascii_digits(c), "[^0-9+-]", "")
    return F.when(c.rlike(SHORT_COUNT), c.try_cast("bigint")).when(
        is_whole_number(c), digits.try_cast("bigint")
    )
