"""The 25 rules, as one row-local projection."""

from collections import namedtuple
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docproof.functions.parsing import is_whole_number, parse_days, parse_iso_date
from docproof.functions.predicates import (
    due_date_overflows,
    iban_check_fails,
    iban_digits,
    is_checksum_ok,
    is_iban_like,
    is_issue_date_plausible,
    is_known_iban_country,
    is_payment_after_issue,
    is_payment_consistent,
    is_valid_currency_code,
)
from docproof.functions.reference_data import CURRENCIES, IBAN_LENGTHS
from docproof.functions.text import is_absent, is_present
from docproof.operators.grounding import ground, with_cents
from docproof.schema import FIELDS, ISSUE, record_struct

ERROR, WARNING = "error", "warning"

Rule = namedtuple("Rule", "no name field severity fires message")


def with_typed_fields(df: DataFrame, iban_lengths=IBAN_LENGTHS) -> DataFrame:
    """Parsed dates and terms, and the outcome of the account checks, once per row."""
    account = F.col("account")
    return df.withColumns(
        {
            "_issue": parse_iso_date(F.col("issue_date")),
            "_payment": parse_iso_date(F.col("payment_date")),
            "_days": parse_days(F.col("payment_terms_days")),
            "_days_readable": F.coalesce(is_whole_number(F.col("payment_terms_days")), F.lit(False)),
            "_iban_like": is_iban_like(account),
            "_iban_digits": iban_digits(account, iban_lengths),
        }
    ).withColumn("_iban_valid", is_checksum_ok(F.col("_iban_digits")))


def rules(ref_date: Column, iban_lengths, currencies) -> list[Rule]:
    """All rules in reporting order, over the columns that the earlier steps prepared."""
    c = F.col
    present = {f: is_present(c(f)) for f in FIELDS}
    absent = {f: is_absent(c(f)) for f in FIELDS}

    def quoted(field):
        return F.concat(F.lit(f"{field} '"), c(field), F.lit("'"))

    def unreadable(no, field, parsed, what):
        return Rule(no, f"{field}_unreadable", field, ERROR, present[field] & ~parsed,
                    F.concat(quoted(field), F.lit(f" is {what}")))

    def missing(no, field, severity):
        return Rule(no, f"{field}_missing", field, severity, absent[field], F.lit(f"{field} is missing"))

    def ungrounded(no, field, severity):
        return Rule(no, f"{field}_not_grounded", field, severity, ~c(f"{field}_grounded"),
                    F.lit(f"{field} was not found verbatim in the source text"))

    known_issue = c("_issue").isNotNull()
    return [
        unreadable(1, "issue_date", c("_issue").isNotNull(), "not a valid ISO date"),
        unreadable(2, "payment_date", c("_payment").isNotNull(), "not a valid ISO date"),
        unreadable(3, "amount", c("parsed_amount_readable"), "not a valid number"),
        unreadable(4, "payment_terms_days", c("_days_readable"), "not a whole number"),
        missing(5, "invoice_number", ERROR),
        missing(6, "issue_date", ERROR),
        missing(7, "amount", ERROR),
        missing(8, "account", ERROR),
        missing(9, "tax_id", ERROR),
        missing(10, "company_name", WARNING),
        missing(11, "company_address", WARNING),
        missing(12, "currency", WARNING),
        Rule(13, "payment_missing", "payment_date", ERROR,
             absent["payment_date"] & absent["payment_terms_days"],
             F.lit("Either payment_date or payment_terms_days is needed")),
        Rule(14, "no_text_layer", "document", WARNING, ~c("has_text"),
             F.lit("The document has no text layer; it may be a scan")),
        ungrounded(15, "company_name", WARNING),
        ungrounded(16, "invoice_number", ERROR),
        ungrounded(17, "account", ERROR),
        ungrounded(18, "tax_id", ERROR),
        ungrounded(19, "amount", ERROR),
        Rule(20, "iban_country_unknown", "account", WARNING,
             c("_iban_valid") & ~is_known_iban_country(c("account"), iban_lengths),
             F.lit("The IBAN's country code is not in the list")),
        Rule(21, "iban_invalid", "account", ERROR, c("_iban_like") & ~c("_iban_valid"),
             F.concat(F.lit("'"), c("account"), F.lit("' looks like an IBAN but fails its checks"))),
        Rule(22, "currency_unknown", "currency", WARNING,
             present["currency"] & ~is_valid_currency_code(c("currency"), currencies),
             F.concat(F.lit("'"), c("currency"), F.lit("' is not an ISO 4217 currency code"))),
        Rule(23, "issue_date_in_future", "issue_date", ERROR,
             known_issue & ~is_issue_date_plausible(c("_issue"), ref_date),
             F.lit("The issue date is after the reference date")),
        Rule(24, "payment_before_issue", "payment_date", ERROR,
             known_issue & ~is_payment_after_issue(c("_issue"), c("_payment")),
             F.lit("The payment date is before the issue date")),
        Rule(25, "payment_inconsistent", "payment_date", ERROR,
             known_issue & ~is_payment_consistent(c("_issue"), c("_payment"), c("_days")),
             F.lit("The payment date is not the issue date plus the payment terms")),
    ]


def evaluation_error(iban_lengths) -> Column:
    """Values that read as numbers but that no rule can compute with."""
    c = F.col
    return (
        F.when(
            c("has_text") & is_present(c("amount")) & c("parsed_amount_readable") & c("cents").isNull(),
            "ValueError: the amount cannot be rounded to cents",
        )
        .when(iban_check_fails(c("account"), iban_lengths), "ValueError: the account ends in a line feed")
        .when(
            due_date_overflows(c("_issue"), c("_payment"), c("_days"), c("_days_readable")),
            "OverflowError: issue date plus payment terms is no date",
        )
    )


def apply_rules(
    df: DataFrame, ref_date: date | str, iban_lengths=IBAN_LENGTHS, currencies=CURRENCIES, keep=()
) -> DataFrame:
    """Verdicts from records with their facts. Rows with an error keep it and get no verdict.

    ``keep`` names further columns to carry along.

    Which rules fire is first packed into one integer; flag and status come from its bits, and
    the issue array is built only for rows that have any issue.
    """
    reference = F.lit(str(ref_date)).cast("date")
    table = rules(reference, iban_lengths, currencies)
    fired = reduce(
        lambda acc, r: acc.bitwiseOR(F.when(r.fires, F.lit(1 << r.no)).otherwise(0)), table, F.lit(0)
    )
    errors = sum(1 << r.no for r in table if r.severity == ERROR)
    typed = with_typed_fields(df, iban_lengths)
    # A one-row generator: filters on the verdict stop here, else Spark would repeat all rules
    # inside the filter, once per place that reads their outcome. Its input is a projection of its own,
    # because what stands inside a generator is not compiled; and an outer one, because Spark would filter
    # the others' inputs for empty arrays first, which makes them twice.
    outcome = F.struct(fired.alias("fired"), F.coalesce("error", evaluation_error(iban_lengths)).alias("error"))
    columns = [c for c in typed.columns if c != "error"]
    typed = typed.select("*", F.array(outcome).alias("_outcome")).select(*columns, F.inline_outer("_outcome"))

    texts = F.struct(*[r.message.alias(f"m{r.no}") for r in table])
    typed = typed.withColumn("_messages", F.when(F.col("fired") != 0, texts))
    none = f"cast(array() as array<{ISSUE.simpleString()}>)"
    entries = ", ".join(
        f"if(fired & {1 << r.no} != 0, array(named_struct('rule_no', {r.no}, 'rule', '{r.name}', 'field', '{r.field}', "
        f"'message', _messages.m{r.no}, 'severity', '{r.severity}')), {none})"
        for r in table
    )
    issues = F.expr(f"if(fired = 0, {none}, concat({entries}))")

    usable = F.col("error").isNull()
    return typed.select(
        "path",
        F.when(usable, record_struct()).alias("data"),
        F.when(usable, issues).alias("issues"),
        F.when(usable, flag_for_review(errors)).alias("flagged"),
        "error",
        status(errors).alias("status"),
        reference.alias("ref_date"),
        *keep,
    )


def flag_for_review(errors: int) -> Column:
    """True when any rule of severity error fired; warnings never flag."""
    return F.col("fired").bitwiseAND(errors) != 0


def status(errors: int) -> Column:
    return F.when(F.col("error").isNotNull(), "error").when(flag_for_review(errors), "flagged").otherwise("ok")


def validate(
    df: DataFrame,
    ref_date: date | str,
    iban_lengths=IBAN_LENGTHS,
    currencies=CURRENCIES,
    strict_cents: bool = False,
) -> DataFrame:
    """Check records (path, ten fields, raw_text, optional error) and add the verdict."""
    if "error" not in df.columns:
        df = df.withColumn("error", F.lit(None).cast("string"))
    grounded = ground(with_cents(df), strict_cents)
    return apply_rules(grounded, ref_date, iban_lengths, currencies)
