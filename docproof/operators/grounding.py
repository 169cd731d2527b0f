"""Facts that need the source text: text layer, and which fields occur in it.

Ordinary documents are one row with their text. Documents of more characters than a row should hold
come as several blocks of whole pages: every block is checked alone, and what could run over the
ends of blocks is checked on their seams. Both give the same facts.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docproof.functions.parsing import to_cents, with_amount
from docproof.functions.predicates import (
    has_text_layer,
    is_amount_grounded,
    is_present,
    quick_grounding,
    whole_and_cents,
)
from docproof.functions.text import WS, normalize_text

# The text fields looked up in the source, in the order they are reported.
GROUNDED = ["company_name", "invoice_number", "account", "tax_id"]
FOUND = [f"{f}_found" for f in [*GROUNDED, "amount"]]


def with_cents(df: DataFrame) -> DataFrame:
    """Parsed amount and its value in cents, once per row."""
    return with_amount(df, "amount").withColumn("cents", to_cents(F.col("parsed_amount")))


def find(df: DataFrame, strict_cents: bool = False, cut: Column | None = None) -> DataFrame:
    """Replace ``raw_text`` by ``has_text`` and what is found in this text.

    The text is normalized only for rows where a plain search did not settle every field, and
    then once for all of them. Where ``cut`` says that the text is only a block of its document,
    ``plain`` and ``digits`` are what its ends show to its neighbours.
    """
    cut = F.lit(False) if cut is None else cut
    text = F.col("raw_text")
    df = df.withColumns({"has_text": has_text_layer(text), "_cut": cut})
    quick = {
        f"_{f}": F.when(F.col("has_text") & is_present(F.col(f)), quick_grounding(F.col(f), text)).otherwise(False)
        for f in GROUNDED
    }
    undecided = reduce(Column.__or__, [F.col(c).isNull() for c in quick])
    amount = F.when(
        F.col("has_text") & F.col("cents").isNotNull(),
        is_amount_grounded(F.col("cents"), text, strict_cents),
    ).otherwise(False)
    found = {
        f"{f}_found": F.coalesce(F.col(f"_{f}"), F.contains(F.col("_normalized"), normalize_text(F.col(f))))
        for f in GROUNDED
    }
    return (
        df.withColumns(quick)
        .withColumn("_normalized", F.when(undecided | F.col("_cut"), normalize_text(text)))
        .withColumns({
            **found, "amount_found": amount,
            "plain": F.when(F.col("_cut"), _ends(F.col("_normalized"), _longest_value(), "\n")),
            "digits": F.when(F.col("_cut"), _ends(encode_digits(text), _longest_amount(), FOREIGN_DIGIT + "x")),
        })
        .drop("raw_text", "_normalized", "_cut", *quick)
    )


def conclude(df: DataFrame) -> DataFrame:
    """What was found, as facts. Absent fields, and documents without text, count as grounded."""
    searched = {f: is_present(F.col(f)) for f in GROUNDED} | {"amount": F.col("cents").isNotNull()}
    facts = {f"{f}_grounded": ~F.col("has_text") | ~present | F.col(f"{f}_found") for f, present in searched.items()}
    return df.withColumns(facts).drop(*FOUND)


def ground(df: DataFrame, strict_cents: bool = False) -> DataFrame:
    """Replace ``raw_text``, the document's whole text, by the facts."""
    return conclude(find(df, strict_cents).drop("plain", "digits"))


# ---------------------------------------------------------------- documents in blocks

# Fixed value: a digit that no amount is written with; after the cut end of a number it says that the number goes on.
FOREIGN_DIGIT = "\u0660"


def encode_digits(text: Column) -> Column:
    """What matters for finding amounts: digit groups opened by ``<``, marks as dots, else ``x``.

    Whitespace and underscores go, and three or more marks in a row become two, because only one
    mark can be a decimal mark and any number of them can separate integer digits.
    """
    other = F.regexp_replace(text, rf"[^\p{{Nd}}{WS}.,_]+", "x")
    opened = F.regexp_replace(other, r"(?<!\p{Nd})(\p{Nd})", "<$1")
    marks = F.replace(F.regexp_replace(opened, rf"[{WS}_]+", ""), F.lit(","), F.lit("."))
    return F.regexp_replace(marks, r"\.{3,}", "..")


def encoded_amount_pattern(whole: Column, fraction: Column) -> Column:
    """The amount as a pattern over ``encode_digits`` and one more character.

    What follows the cents must be there and be no digit: a seam may be cut in the middle of a
    number, and the end of the document is marked by a letter.
    """
    digits = F.regexp_replace(whole, "([0-9])(?=[0-9])", r"$1(?:\\.*<)?+")
    return F.concat(F.lit("<"), digits, F.lit(r"\.<"), fraction, F.lit(r"(?=\P{Nd})"))


def _longest_value() -> Column:
    return F.greatest(*[F.coalesce(F.length(normalize_text(F.col(f))), F.lit(0)) for f in GROUNDED], F.lit(1))


def _longest_amount() -> Column:
    """Characters that an amount takes in ``encode_digits`` at most."""
    return 6 * F.coalesce(F.length(F.col("cents").cast("string")), F.lit(0)) + 2


def _ends(text: Column, size: Column, between: str) -> Column:
    """First and last ``size`` characters with something between that no value runs over; short texts whole."""
    return F.when(F.length(text) <= 2 * size, text).otherwise(
        F.concat(F.left(text, size), F.lit(between), F.right(text, size))
    )


def combine(blocks: DataFrame, strict_cents: bool = False) -> DataFrame:
    """One row per document from its blocks (path, place, record, and what ``find`` gives).

    A value that lies in no single block runs over the seam of two neighbours, or over several that
    are shorter than itself and whole in the seams. Ordinary documents have one block and no seams.
    """
    ends = F.when(F.col("plain").isNotNull(), F.struct("place", "plain", "digits"))
    joined = (
        blocks.withColumn("seam", ends)
        .groupBy("path")
        .agg(
            F.any_value("record").alias("record"),
            F.bool_or("has_text").alias("has_text"),
            F.bool_or("has_pages").alias("has_pages"),
            *[F.bool_or(c).alias(c) for c in FOUND],
            F.sort_array(F.collect_list("seam")).alias("seams"),
        )
        .select("path", "record.*", "has_text", "has_pages", *FOUND, "seams")
    )
    has_seams = F.size("seams") > 1
    whole, fraction = whole_and_cents(F.col("cents"), strict_cents)
    over_seams = {
        f"{f}_found": F.contains(F.col("_plain"), normalize_text(F.col(f))) & is_present(F.col(f)) for f in GROUNDED
    } | {"amount_found": F.rlike(F.col("_digits"), encoded_amount_pattern(whole, fraction))}
    return (
        joined.withColumns({
            "_plain": F.when(has_seams, F.array_join(F.col("seams")["plain"], "")),
            "_digits": F.when(has_seams, F.concat(F.array_join(F.col("seams")["digits"], ""), F.lit("x"))),
        })
        .withColumns({c: F.col(c) | F.coalesce(over, F.lit(False)) for c, over in over_seams.items()})
        .drop("seams", "_plain", "_digits")
    )
