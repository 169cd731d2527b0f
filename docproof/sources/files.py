"""Document files: listing, page counts, and requests for the extraction service."""

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from docproof.schema import FIELDS

PDF_GLOB = "*.{pdf,PDF}"
# Fixed value: the columns of Spark's binary file source.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def scan_files(spark: SparkSession, folder: str, glob: str = PDF_GLOB) -> DataFrame:
    """(path, name) of the files directly in a folder, by lower-cased name. Content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return (
        files.select("path")
        .dropDuplicates(["path"])
        .withColumn("name", file_name(F.col("path")))
        .orderBy(F.lower("name"), "path")
    )


def stream_files(spark: SparkSession, folder: str, listing: str, checkpoint: str, glob: str = PDF_GLOB) -> StreamingQuery:
    """Append the files that no earlier call has listed to the table ``listing`` (path, name), and end.

    The checkpoint remembers which files were seen, so a call costs one listing of the folder and no
    content is read.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).load(folder)
    directly = F.regexp_replace("path", "/[^/]*$", "").endswith(folder.rstrip("/").split("://")[-1])
    named = files.select("path").filter(directly).withColumn("name", file_name(F.col("path")))
    return (
        named.writeStream.format("parquet").option("path", listing)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def unanswered(files: DataFrame, responses: DataFrame) -> DataFrame:
    """The listed files that have no response yet: what is left to ask the extraction service for."""
    return files.dropDuplicates(["path"]).join(responses.select("path"), "path", "left_anti")


def read_files(spark: SparkSession, folder: str, glob: str = PDF_GLOB) -> DataFrame:
    """(path, content) of the files directly in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select("path", "content")


def page_count(files: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, n_pages) for every file; 0 where no page is known. Counted before the join."""
    counts = pages.groupBy("path").agg(F.count("page_no").alias("n_pages"))
    return files.select("path").distinct().join(counts, "path", "left").fillna(0, ["n_pages"])


DEFAULT_BUYER = "the receiving company"


def extraction_prompt(buyer: str | None) -> str:
    """What the rules need of a response: who is meant, and how each value must be written."""
    return (
        f"Fill in the fields for the party that is owed money; {buyer or DEFAULT_BUYER} pays it and "
        "is not to be described. Values are checked by searching for them in the document: text "
        "fields must be found there letter by letter, apart from spaces, case and the marks , . - /. "
        "A field that the document does not show is null. Write dates in ISO 8601 form with four, two "
        "and two digits, amounts with digits, one point and two decimals, and day counts as whole "
        "numbers."
    )


# Per field what the checks compare it with.
FIELD_NOTES = {
    "company_name": "Searched in the text.",
    "company_address": "Must not be empty.",
    "invoice_number": "Searched in the text.",
    "issue_date": "ISO date, not in the future.",
    "payment_date": "ISO date, on or after issue_date; needed unless payment_terms_days is given.",
    "payment_terms_days": "Whole days from issue_date to payment_date.",
    "amount": "The sum owed, searched in the text in any layout of its digits.",
    "currency": "Code of ISO 4217, upper case.",
    "tax_id": "Searched in the text.",
    "account": "Searched in the text; an IBAN must pass its check digits.",
}


def response_schema() -> dict:
    """Strict JSON schema of a response: every field required, text or null, nothing else."""
    return {
        "type": "object",
        "properties": {
            f: {"anyOf": [{"type": "string"}, {"type": "null"}], "description": FIELD_NOTES[f]}
            for f in FIELDS
        },
        "required": list(FIELDS),
        "additionalProperties": False,
    }


SCHEMA_NAME = "document_record"


def build_extraction_requests(files: DataFrame, buyer: str | None = None) -> DataFrame:
    """One request per file of (path, content): prompt, data URL and response schema.

    Spark's base64 breaks lines every 76 characters; a data URL must not.
    """
    encoded = F.translate(F.base64("content"), "\r\n", "")
    return files.select(
        "path",
        file_name(F.col("path")).alias("filename"),
        F.lit(extraction_prompt(buyer)).alias("prompt"),
        F.concat(F.lit("data:application/pdf;base64,"), encoded).alias("file_data"),
        F.lit(json.dumps(response_schema())).alias("schema_json"),
    )


def write_requests(requests: DataFrame, folder: str) -> None:
    """Requests as JSON lines, one per file: path, prompt, file, and the strict schema by name."""
    schema = F.struct(
        F.lit(SCHEMA_NAME).alias("name"), F.lit(True).alias("strict"), F.parse_json("schema_json").alias("schema")
    )
    requests.select(
        "path", "prompt", F.struct("filename", "file_data").alias("file"), schema.alias("response_schema")
    ).write.mode("overwrite").json(folder)
