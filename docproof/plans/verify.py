"""The whole job: files, pages and responses in, verdicts out; and re-checks after edits."""

from datetime import date

from pyspark.sql import DataFrame, functions as F

from docproof.functions.reference_data import CURRENCIES, IBAN_LENGTHS
from docproof.operators.edits import applicable, overlay_edits
from docproof.operators.grounding import GROUNDED, combine, conclude, find, with_cents
from docproof.operators.pairing import MISSING_TEXT, capture_records
from docproof.operators.rules import apply_rules
from docproof.schema import FIELDS, unpack
from docproof.sources.pages import BLOCK_CHARS, MAX_CHARS, beyond_first_range, block_of, joined_text, range_of


def _kept_by_path(pages: DataFrame) -> bool:
    """Whether the table is stored so that all pages of a document are read by one task (``save_bucketed``)."""
    return "hashpartitioning(path" in pages._jdf.queryExecution().sparkPlan().outputPartitioning().toString()


def with_facts(
    records: DataFrame,
    pages: DataFrame,
    strict_cents: bool = False,
    max_chars: int = MAX_CHARS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Records (path, ten fields, error), one per path, with the facts that their document's text gives.

    The text is shuffled once, by path and range of page numbers, so that the pages of a huge
    document are dealt over tasks; a first look at the page numbers alone tells which ranges besides
    the first a record has to be sent to. A range is one row of text, or several blocks if it has more
    than ``max_chars`` characters. Building the plan starts no job.
    """
    columns = ["path", *FIELDS, "error"]
    records = with_cents(records.select(*columns, *[c for c in records.columns if c not in columns]))
    record = F.struct(*[c for c in records.columns if c != "path"])
    asked = records.select("path", record.alias("record"))
    if _kept_by_path(pages):
        keys = ["path"]
        asked = asked.withColumns({"_range": F.lit(0).cast("bigint"), "_spread": F.lit(False)})
        pages = pages.select("path", "page_no", "text")
    else:
        keys = ["path", "_range"]
        pages = pages.select("path", range_of(F.col("page_no")).alias("_range"), "page_no", "text")
        # Ordinary documents have no page beyond the first range, and the scan's statistics skip them.
        others = pages.filter(beyond_first_range(F.col("page_no"))).groupBy("path").agg(F.collect_set("_range").alias("_others"))
        first = F.array(F.lit(0).cast("bigint"))
        asked = asked.join(others, "path", "left").select(
            "path", "record", F.explode(F.coalesce(F.concat(first, "_others"), first)).alias("_range"),
            F.col("_others").isNotNull().alias("_spread"),
        )
    # Texts are put together before the join, so that records are not carried along with every page.
    texts = pages.withColumn("_block", block_of(keys, max_chars, block_chars)).groupBy(*keys, "_block").agg(
        joined_text().alias("raw_text")
    )
    blocks = asked.join(texts, keys, "left").select(
        "path", F.struct("_range", "_block").alias("place"), "record", *[F.col(f"record.{c}") for c in [*GROUNDED, "cents"]],
        F.col("raw_text").isNotNull().alias("has_pages"),
        (F.col("_spread") & F.col("raw_text").isNotNull() | F.col("_block").isNotNull()).alias("cut"),
        F.coalesce("raw_text", F.lit("")).alias("raw_text"),
    )
    facts = conclude(combine(find(blocks, strict_cents, F.col("cut")), strict_cents))
    no_pages = F.when(~F.col("has_pages"), MISSING_TEXT)
    return facts.withColumn("error", F.coalesce("error", no_pages)).drop("has_pages")


def verify_documents(
    files: DataFrame,
    pages: DataFrame,
    responses: DataFrame,
    ref_date: date | str,
    iban_lengths=IBAN_LENGTHS,
    currencies=CURRENCIES,
    **options,
) -> DataFrame:
    """One verdict per file: (path, data, extracted, issues, flagged, error, status, ref_date, version)."""
    facts = with_facts(capture_records(files, responses), pages, **options)
    verdicts = apply_rules(facts, ref_date, iban_lengths, currencies)
    return verdicts.withColumns({"extracted": F.col("data"), "version": F.lit(0).cast("bigint")})


def recheck_edited(
    results: DataFrame,
    log: DataFrame,
    pages: DataFrame,
    ref_date: date | str,
    iban_lengths=IBAN_LENGTHS,
    currencies=CURRENCIES,
    **options,
) -> DataFrame:
    """New versions of the documents that the log touches; ``results`` are their stored first verdicts.

    Pages of other documents are dropped before the text is shuffled: while the log is small, by a
    broadcast of its paths. The version is the highest seq applied, so running the same log again
    gives the same version.
    """
    snapshots = results.filter(F.col("extracted").isNotNull()).select("path", "extracted")
    current = overlay_edits(snapshots, log, "inner")
    records = current.select(
        "path", *unpack("data"), F.lit(None).cast("string").alias("error"), "extracted",
        F.col("seq").alias("version"),
    )
    needed = pages.join(applicable(log).select("path"), "path", "left_semi")
    facts = with_facts(records, needed, **options)
    return apply_rules(facts, ref_date, iban_lengths, currencies, keep=["extracted", "version"])
