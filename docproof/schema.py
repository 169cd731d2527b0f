"""Column names and types shared by every stage."""

from pyspark.sql import Column, functions as F, types as T

# The record's fields, in the order the review table shows them.
FIELDS = [
    "company_name",
    "company_address",
    "invoice_number",
    "issue_date",
    "payment_date",
    "payment_terms_days",
    "amount",
    "currency",
    "tax_id",
    "account",
]

RECORD = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])

ISSUE = T.StructType(
    [
        T.StructField("rule_no", T.IntegerType()),
        T.StructField("rule", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("severity", T.StringType()),
    ]
)

PAGE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("page_no", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)

RESPONSE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("output_text", T.StringType()),
    ]
)

# A response of a stream, with its document's page count if the sender knows it.
WAITING = T.StructType([*RESPONSE.fields, T.StructField("n_pages", T.LongType())])

EDIT = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


PATH = T.StructType([T.StructField("path", T.StringType())])

# What re-checks need of stored verdicts.
EXTRACTED = T.StructType([*PATH.fields, T.StructField("extracted", RECORD)])


def in_batches(schema: T.StructType) -> T.StructType:
    """The schema of rows that are stored in one folder per micro-batch."""
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def record_struct(prefix: str = "") -> Column:
    """The ten field columns packed into one struct."""
    return F.struct(*[F.col(prefix + f).alias(f) for f in FIELDS])


def unpack(struct_name: str) -> list[Column]:
    """The ten fields of a struct column as top-level columns."""
    return [F.col(struct_name)[f].alias(f) for f in FIELDS]
