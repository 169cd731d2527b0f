"""One row per file: extraction and text side by side, failures as an error column."""

from pyspark.sql import DataFrame, functions as F

from docproof.schema import FIELDS
from docproof.sources.responses import ingest_responses, one_response_per_path


MISSING_TEXT = "MissingText: no pages for this document"


def capture_records(files: DataFrame, responses: DataFrame) -> DataFrame:
    """(path, ten fields, error): exactly one row per file, whatever its response looks like."""
    single = one_response_per_path(responses)
    per_file = files.select("path").distinct().join(single, "path", "left")
    ingested = ingest_responses(per_file)
    error = (
        F.when(F.col("n_responses").isNull(), "MissingResponse: no extraction response")
        .when(F.col("n_responses") > 1, "DuplicateResponse: more than one extraction response")
        .otherwise(F.col("error"))
    )
    return ingested.withColumn("error", error).drop("n_responses")


def pair_with_text(extractions: DataFrame, texts: DataFrame) -> DataFrame:
    """Extractions with their document's text; null where the document has no pages."""
    return extractions.join(texts.select("path", "raw_text"), "path", "left")


def missing_text(paired: DataFrame) -> DataFrame:
    """Turn a missing text into an error; an earlier error stays."""
    no_pages = F.when(F.col("raw_text").isNull(), MISSING_TEXT)
    return paired.withColumn("error", F.coalesce("error", no_pages))


def capture_errors(files: DataFrame, responses: DataFrame, texts: DataFrame) -> DataFrame:
    """Exactly one row per file with record and text; error rows carry neither."""
    paired = missing_text(pair_with_text(capture_records(files, responses), texts))
    usable = F.col("error").isNull()
    return paired.select(
        "path",
        *[F.when(usable, F.col(c)).alias(c) for c in [*FIELDS, "raw_text"]],
        "error",
    )
