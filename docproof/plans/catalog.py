"""Every operator as a query over the given tables: name → (spark, data folder) → DataFrame."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docproof.functions import parsing, predicates as P, text as X
from docproof.operators import edits as E, pairing, review
from docproof.operators.grounding import GROUNDED, with_cents
from docproof.operators.rules import validate
from docproof.plans.fixture import REF_DATE, Documents, read
from docproof.plans.verify import recheck_edited, verify_documents
from docproof.schema import EDIT, EXTRACTED, FIELDS, RESPONSE, unpack
from docproof.session import prepare, spread, work_folder
from docproof.sources import files as S, pages as G, responses as R, results as W
from docproof.streaming import arrivals, jobs

QUERIES = {}


def query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(prepare(spark), sf_dir)

    QUERIES[f.__name__] = run
    return f


def fired_rules() -> Column:
    """The rules of the issue list in order, such as ``R09 R15``; null for failed documents."""
    names = F.expr("transform(issues, i -> concat('R', lpad(cast(i.rule_no as string), 2, '0')))")
    return F.array_join(names, " ").alias("rules")


def verdicts_of(d: Documents, **options) -> DataFrame:
    return verify_documents(d.files, d.pages, d.responses, REF_DATE, **options)


def records_with_text(d: Documents) -> DataFrame:
    """Faulty records with their text, as the column checks see them."""
    return d.faulty.join(G.join_pages(d.pages, "path"), "path", "left")


def typed_dates(d: Documents) -> DataFrame:
    return d.faulty.select(
        "path",
        parsing.parse_iso_date(F.col("issue_date")).alias("issued"),
        parsing.parse_iso_date(F.col("payment_date")).alias("paid"),
        parsing.parse_days(F.col("payment_terms_days")).alias("days"),
    )


def checked(df: DataFrame, check: Column) -> DataFrame:
    return df.select("path", check.alias("result"))


# ---------------------------------------------------------------- the whole job

@query
def verify_documents_end_to_end(spark, sf_dir):
    v = verdicts_of(Documents(spark, sf_dir))
    return v.select("path", "status", "flagged", "error", fired_rules())


@query
def verify_long_documents(spark, sf_dir):
    """Every document takes the block-by-block way, in blocks far shorter than its text."""
    v = verdicts_of(Documents(spark, sf_dir), max_chars=0, block_chars=40)
    return v.select("path", "status", "flagged", "error", fired_rules())


# ---------------------------------------------------------------- sources and sinks

@query
def scan_files(spark, sf_dir):
    folder = work_folder(spark, "files")
    items = read(spark, sf_dir, "benchmark").select("text")
    items.write.option("maxRecordsPerFile", 1).text(folder)
    found = S.scan_files(spark, folder, "*.txt")
    return found.agg(
        F.count("path").alias("n_files"),
        F.count_if(F.col("path").endswith(F.col("name"))).alias("n_names"),
        F.max(F.substring_index("name", ".", -1)).alias("suffix"),
    )


@query
def build_extraction_requests(spark, sf_dir):
    documents = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    files = documents.select(
        F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )
    return S.build_extraction_requests(files)


@query
def ingest_responses(spark, sf_dir):
    return R.ingest_responses(Documents(spark, sf_dir).responses)


@query
def assemble_text(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    pages = turns.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("page_no"), "text")
    return G.assemble_text(pages)


@query
def assemble_text_in_parts(spark, sf_dir):
    """Conversations in parts of 200 characters, cut between turns."""
    turns = read(spark, sf_dir, "conversations")
    pages = turns.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("page_no"), "text")
    return G.assemble_text(pages, part_chars=200)


@query
def page_count(spark, sf_dir):
    d = Documents(spark, sf_dir)
    return S.page_count(d.files, d.pages)


@query
def write_results(spark, sf_dir):
    folder = work_folder(spark, "results")
    v = verdicts_of(Documents(spark, sf_dir)).select("path", "status")
    odd = F.substring("path", -5, 1).cast("int") % 2 == 1
    W.write_results(v.filter(~odd), folder, "first")
    W.write_results(v.filter(odd), folder, "second")
    W.write_results(v.filter(odd), folder, "second")
    return W.read_results(spark, folder).groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n_documents"))


@query
def export_json(spark, sf_dir):
    return W.export_json(verdicts_of(Documents(spark, sf_dir)))


# ---------------------------------------------------------------- joins

@query
def pair_with_text(spark, sf_dir):
    d = Documents(spark, sf_dir)
    paired = pairing.pair_with_text(R.ingest_responses(d.responses), G.join_pages(d.pages, "path"))
    return paired.select("path", "invoice_number", "raw_text")


@query
def capture_errors(spark, sf_dir):
    d = Documents(spark, sf_dir)
    rows = pairing.capture_errors(d.files, d.responses, G.join_pages(d.pages, "path"))
    return rows.select("path", "invoice_number", "raw_text", "error")


@query
def lookup_country_length(spark, sf_dir):
    d = Documents(spark, sf_dir)
    return d.faulty.select("path", P.lookup_country_length(F.col("account")).alias("country_length"))


@query
def overlay_edits(spark, sf_dir):
    d = Documents(spark, sf_dir)
    snapshots = d.faulty.select("path", F.struct(*FIELDS).alias("extracted"))
    return E.overlay_edits(snapshots, d.edits).select("path", *unpack("data"))


@query
def changed_only(spark, sf_dir):
    d = Documents(spark, sf_dir)
    return E.changed_only(d.first_verdicts(), d.edits).select("path", "status")


@query
def rejected_edits(spark, sf_dir):
    d = Documents(spark, sf_dir)
    k = F.col("k")
    strays = d.clean.filter(k % 5 == 0).select(
        F.when(k % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("/old"), "path")).alias("path"),
        F.when(k % 2 == 0, "vat_rate").otherwise("amount").alias("field"),
        F.lit(9).cast("bigint").alias("seq"),
        F.when(k % 3 == 0, "drop").otherwise("edit").alias("op"),
        F.lit("23").alias("text"),
    )
    return E.rejected_edits(d.first_verdicts(), d.edits.unionByName(strays)).drop("text")


# ---------------------------------------------------------------- typed projection

def _inputs(d: Documents, *fields: str) -> DataFrame:
    return d.faulty.select("path", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("input")) for f in fields])))


@query
def parse_iso_date(spark, sf_dir):
    rows = _inputs(Documents(spark, sf_dir), "issue_date", "payment_date")
    return rows.withColumn("result", parsing.parse_iso_date(F.col("input")).cast("string"))


@query
def parse_amount(spark, sf_dir):
    rows = parsing.with_amount(_inputs(Documents(spark, sf_dir), "amount"), "input", "a")
    return rows.select(
        "path", "input", F.col("a_readable").alias("readable"), parsing.to_cents(F.col("a")).cast("string").alias("result")
    )


@query
def parse_days(spark, sf_dir):
    rows = _inputs(Documents(spark, sf_dir), "payment_terms_days")
    return rows.select("path", "input", parsing.parse_days(F.col("input")).alias("result"))


@query
def normalize_text(spark, sf_dir):
    documents = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    normalized = X.normalize_text(F.col("text"))
    return documents.select("doc_id", F.length(normalized).alias("n_chars"), F.md5(normalized).alias("digest"))


@query
def clean_account(spark, sf_dir):
    rows = _inputs(Documents(spark, sf_dir), "account")
    return rows.select("path", "input", X.clean_account(F.col("input")).alias("result"))


# ---------------------------------------------------------------- predicates

@query
def has_text_layer(spark, sf_dir):
    return checked(records_with_text(Documents(spark, sf_dir)), P.has_text_layer(F.col("raw_text")))


@query
def is_grounded(spark, sf_dir):
    rows = records_with_text(Documents(spark, sf_dir))
    return rows.select("path", *[P.is_grounded(F.col(f), F.col("raw_text")).alias(f) for f in GROUNDED])


@query
def is_grounded_in_prose(spark, sf_dir):
    """A passage from anywhere in each document, the end included, with blanks, commas or a letter changed."""
    last = F.greatest(F.length("text") - 59, F.lit(1))
    start = F.when(F.col("doc_id") % 5 == 4, last).otherwise(F.col("doc_id") * 7919 % last + 1).cast("int")
    passage = F.substr("text", start, F.lit(60))
    value = (
        F.when(F.col("doc_id") % 3 == 0, F.translate(passage, " ,", "-/"))
        .when(F.col("doc_id") % 3 == 1, F.upper(F.replace(passage, F.lit(" "))))
        .otherwise(F.translate(passage, "e", "q"))
    )
    documents = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    rows = documents.select("doc_id", "text", value.alias("value"))
    return rows.select("doc_id", P.is_grounded(F.col("value"), F.col("text")).alias("result"))


@query
def is_amount_grounded(spark, sf_dir):
    rows = with_cents(records_with_text(Documents(spark, sf_dir)))
    return checked(rows, P.is_amount_grounded(F.col("cents"), F.col("raw_text")))


@query
def is_amount_grounded_strict(spark, sf_dir):
    rows = with_cents(records_with_text(Documents(spark, sf_dir)))
    return checked(rows, P.is_amount_grounded(F.col("cents"), F.col("raw_text"), strict_cents=True))


@query
def is_iban_like(spark, sf_dir):
    return checked(Documents(spark, sf_dir).faulty, P.is_iban_like(F.col("account")))


@query
def is_valid_iban(spark, sf_dir):
    return checked(Documents(spark, sf_dir).faulty, P.is_valid_iban(F.col("account")))


@query
def is_known_iban_country(spark, sf_dir):
    return checked(Documents(spark, sf_dir).faulty, P.is_known_iban_country(F.col("account")))


@query
def is_valid_currency_code(spark, sf_dir):
    return checked(Documents(spark, sf_dir).faulty, P.is_valid_currency_code(F.col("currency")))


@query
def is_issue_date_plausible(spark, sf_dir):
    rows = typed_dates(Documents(spark, sf_dir))
    return checked(rows, P.is_issue_date_plausible(F.col("issued"), F.lit(REF_DATE).cast("date")))


@query
def is_payment_after_issue(spark, sf_dir):
    return checked(typed_dates(Documents(spark, sf_dir)), P.is_payment_after_issue(F.col("issued"), F.col("paid")))


@query
def is_payment_consistent(spark, sf_dir):
    rows = typed_dates(Documents(spark, sf_dir))
    return checked(rows, P.is_payment_consistent(F.col("issued"), F.col("paid"), F.col("days")))


@query
def is_absent(spark, sf_dir):
    return Documents(spark, sf_dir).faulty.select("path", *[X.is_absent(F.col(f)).alias(f) for f in FIELDS])


# ---------------------------------------------------------------- rules and review tables

@query
def validate_records(spark, sf_dir):
    """The rules on records given with their text, without responses or pages to pair."""
    d = Documents(spark, sf_dir)
    rows = records_with_text(d).filter(F.col("raw_text").isNotNull())
    return validate(rows, REF_DATE).select("path", "error", fired_rules())


@query
def flag_for_review(spark, sf_dir):
    return verdicts_of(Documents(spark, sf_dir)).select("path", "flagged")


@query
def status(spark, sf_dir):
    return verdicts_of(Documents(spark, sf_dir)).select("path", "status")


@query
def issue_rows(spark, sf_dir):
    return review.issue_rows(verdicts_of(Documents(spark, sf_dir)))


@query
def field_severity(spark, sf_dir):
    return review.field_severity(verdicts_of(Documents(spark, sf_dir)))


@query
def field_review(spark, sf_dir):
    return review.field_review(verdicts_of(Documents(spark, sf_dir)))


@query
def field_review_of_edited(spark, sf_dir):
    """The same table for the newest versions of edited documents."""
    d = Documents(spark, sf_dir)
    return review.field_review(recheck_edited(d.first_verdicts(), d.edits, d.pages, REF_DATE))


def _in_two_runs(v: DataFrame) -> DataFrame:
    odd = F.substring("path", -5, 1).cast("int") % 2 == 1
    return v.withColumn("run_id", F.when(odd, "second").otherwise("first"))


@query
def run_summary(spark, sf_dir):
    return review.run_summary(_in_two_runs(verdicts_of(Documents(spark, sf_dir))), "second")


@query
def summary_of_runs(spark, sf_dir):
    """The same numbers from counts that each run has kept; the second run was written twice."""
    folder, v = work_folder(spark, "counts"), _in_two_runs(Documents(spark, sf_dir).first_verdicts())
    for run_id in ("first", "second", "second"):
        W.write_counts(review.run_counts(v.filter(F.col("run_id") == run_id)), folder, run_id)
    return review.summary_of_runs(W.read_results(spark, folder), "second")


@query
def unanswered_files(spark, sf_dir):
    d = Documents(spark, sf_dir)
    return S.unanswered(d.files.unionByName(d.files), d.responses)


@query
def review_list(spark, sf_dir):
    return review.review_list(_in_two_runs(verdicts_of(Documents(spark, sf_dir))))


# ---------------------------------------------------------------- edits

@query
def fold_edits(spark, sf_dir):
    return E.fold_edits(Documents(spark, sf_dir).edits)


@query
def revert_field(spark, sf_dir):
    """Invoice numbers of the documents whose edit of that field was reverted."""
    d = Documents(spark, sf_dir)
    snapshots = d.faulty.select("path", F.struct(*FIELDS).alias("extracted"))
    reverts = d.edits.filter(F.col("op") == "revert").select("path")
    current = E.overlay_edits(snapshots.join(reverts, "path", "left_semi"), d.edits)
    return current.select("path", F.col("data.invoice_number").alias("invoice_number"))


@query
def field_is_edited(spark, sf_dir):
    d = Documents(spark, sf_dir)
    snapshots = d.faulty.select("path", F.struct(*FIELDS).alias("extracted"))
    return E.edited_fields(E.overlay_edits(snapshots, d.edits))


@query
def revalidate(spark, sf_dir):
    d = Documents(spark, sf_dir)
    again = recheck_edited(d.first_verdicts(), d.edits, d.pages, REF_DATE)
    return again.select("path", "version", "status", "error", fired_rules())


# ---------------------------------------------------------------- streams

def _stored(spark, df: DataFrame, purpose: str) -> str:
    folder = work_folder(spark, purpose)
    df.write.parquet(folder)
    return folder


def _stored_by_path(spark, df: DataFrame, purpose: str) -> str:
    folder = work_folder(spark, purpose)
    W.save_by_path(df, folder)
    return folder


def _stream_of(spark, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)


def _streamed_verdicts(spark, d: Documents) -> str:
    """The folder of a finished stream's output, with the verdicts of the drain as its last batch."""
    responses, pages = d.responses_folder, _stored_by_path(spark, d.page_rows(), "pages")
    out = work_folder(spark, "verdicts")
    jobs.stream_validate(
        _stream_of(spark, responses, RESPONSE), pages, out, REF_DATE, work_folder(spark, "progress")
    ).awaitTermination()
    rest = jobs.drain(spark, d.files, pages, out, REF_DATE)
    rest.write.parquet(f"{out}/verdicts/batch_id=999999")
    return f"{out}/verdicts"


@query
def stream_validate(spark, sf_dir):
    v = jobs.read_batches(spark, _streamed_verdicts(spark, Documents(spark, sf_dir)))
    return v.select("path", "status", "error", fired_rules())


@query
def stream_verify(spark, sf_dir):
    """Verdicts of documents whose pages and responses arrive on two streams; what never becomes whole expires."""
    d = Documents(spark, sf_dir)
    day = F.expr("timestamp '2026-01-01 00:00:00' + make_interval(0, 0, 0, pmod(xxhash64(path), 3))")
    end = spark.range(1).select(F.lit("/end").alias("path"), F.lit(1).cast("bigint").alias("page_no"), F.lit("").alias("text"),
                                F.expr("timestamp '2026-03-01 00:00:00'").alias("arrived"))
    pages = _stored(spark, d.page_rows().withColumn("arrived", day).unionByName(end), "arriving-pages")
    answers = d.response_rows().withColumns({"n_pages": F.lit(3).cast("bigint"), "arrived": day})
    responses = _stored(spark, answers, "arriving-responses")
    store, out = work_folder(spark, "pages"), work_folder(spark, "verdicts")
    given = spark.readStream.schema(spark.read.parquet(pages).schema).parquet(pages)
    arrivals.stream_pages(given, store, work_folder(spark, "progress")).awaitTermination()
    kept = spark.readStream.schema(spark.read.parquet(store).schema).parquet(store)
    asked = spark.readStream.schema(answers.schema).parquet(responses)
    events = arrivals.stream_arrivals(kept, asked, "1 hour", "7 days")
    arrivals.stream_verify(events, store, out, REF_DATE, work_folder(spark, "progress")).awaitTermination()
    return jobs.read_batches(spark, f"{out}/verdicts").select("path", "status", "error", fired_rules())


@query
def stream_summary(spark, sf_dir):
    """Counted over the stream of verdicts that the first stream wrote."""
    folder, out = _streamed_verdicts(spark, Documents(spark, sf_dir)), work_folder(spark, "summary")
    verdicts = _stream_of(spark, folder, jobs.read_batches(spark, folder).schema)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(out)

    (
        jobs.stream_summary(verdicts).writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", work_folder(spark, "progress"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(out)


@query
def stream_edits(spark, sf_dir):
    d = Documents(spark, sf_dir)
    # Edits are laid over what was extracted; no other column of the verdicts is read again.
    results = _stored_by_path(spark, d.first_verdicts(keep_pages=False).select(EXTRACTED.names), "results")
    pages = _stored_by_path(spark, d.page_rows(), "pages")
    log, out = d.edits_folder, work_folder(spark, "versions")
    jobs.stream_edits(
        _stream_of(spark, log, EDIT), results, pages, out, REF_DATE, work_folder(spark, "progress")
    ).awaitTermination()
    newest = E.latest_versions(jobs.read_batches(spark, f"{out}/versions"))
    return newest.select("path", "version", "status", "error", fired_rules())
