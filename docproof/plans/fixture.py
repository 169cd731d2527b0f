"""Documents derived from the order tables: one per order, with planned faults.

The plan is written down in FIXTURES.md, part B. ``k`` is the order key, ``k % 50`` picks the fault.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docproof.plans.verify import verify_documents
from docproof.schema import FIELDS
from docproof.session import shared_folder, spread, work_folder

REF_DATE = "2026-07-04"
NBSP = " "


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(k: Column) -> Column:
    return F.concat(F.lit("/inv/"), F.lpad(k.cast("string"), 9, "0"), F.lit(".pdf"))


def _check_digits(bban: Column, country: str) -> Column:
    number = F.concat(bban, F.lit(country + "00")).cast("decimal(38,0)")
    check = F.lit(98) - (number % F.lit(97).cast("decimal(38,0)")).cast("int")
    return F.lpad(check.cast("string"), 2, "0")


def clean_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, v, date columns and the ten fields, all sound."""
    k, v = F.col("o_orderkey"), F.col("o_custkey")
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("issued")
    )
    # s_suppkey counts from 0, so every supplier has documents.
    vendors, nations = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    counted = vendors.agg(F.count(F.lit(1)).alias("n_vendors"))
    vendors = vendors.join(nations, vendors["s_nationkey"] == nations["n_nationkey"])
    # One row, and an aggregate's at that.
    numbered = orders.join(F.broadcast(counted)).withColumn("vendor", v % F.col("n_vendors"))
    joined = spread(numbered.join(vendors, F.col("vendor") == F.col("s_suppkey")), "o_orderkey", orders)
    padded = F.lpad(k.cast("string"), 10, "0")
    german = F.concat(F.lit("37040044"), padded)
    polish = F.concat(F.lit("10901014"), F.lpad(k.cast("string"), 16, "0"))
    terms = (F.lit(14) + F.lit(15) * (v % 3)).cast("int")
    return joined.select(
        k.alias("k"),
        "issued",
        terms.alias("terms"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        path_of(k).alias("path"),
        F.col("s_name").alias("company_name"),
        F.concat_ws(" ", "n_name", F.col("s_suppkey").cast("string")).alias("company_address"),
        F.concat(F.lit("INV-"), F.year("issued"), F.lit("-"), F.lpad(k.cast("string"), 9, "0")).alias("invoice_number"),
        F.col("issued").cast("string").alias("issue_date"),
        F.date_add("issued", terms).cast("string").alias("payment_date"),
        terms.cast("string").alias("payment_terms_days"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"),
        F.when(F.col("n_regionkey") == 0, "USD").when(F.col("n_regionkey") == 1, "PLN")
        .when(F.col("n_regionkey") == 2, "EUR").when(F.col("n_regionkey") == 3, "GBP").otherwise("CNY").alias("currency"),
        F.concat(F.lit("TAX"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0")).alias("tax_id"),
        F.when(k % 3 == 0, F.concat(F.lit("DE"), _check_digits(german, "1314"), german))
        .when(k % 3 == 1, F.concat(F.lit("PL"), _check_digits(polish, "2521"), polish))
        .otherwise(padded).alias("account"),
    )


def _bucket() -> Column:
    return F.col("k") % 50


def _by_bucket(default: Column, cases: dict[int, Column | str | None]) -> Column:
    out = default
    for bucket, value in cases.items():
        out = F.when(_bucket() == bucket, value).otherwise(out)
    return out


UNLISTED_IBAN = "SV92CENR00000000123456789012"
BROKEN_IBAN = "DE89370400440532013001"


def faulty_records(clean: DataFrame) -> DataFrame:
    """path, k and the ten fields with the fault of each document's bucket."""
    absent = F.when(F.floor(F.col("k") / 50) % 2 == 0, "")
    c, price = F.col, F.col("price")
    iso_week = F.concat(
        F.extract(F.lit("yearofweek"), c("issued")).cast("string"), F.lit("-W"),
        F.lpad(F.weekofyear("issued").cast("string"), 2, "0"), F.lit("-"),
        F.extract(F.lit("dow_iso"), c("issued")).cast("string"),
    )
    cases = {
        "company_name": {10: absent, 15: "Other Vendor", 26: "Other Vendor"},
        "company_address": {11: absent},
        "invoice_number": {5: absent, 16: F.concat(F.lit("X"), c("invoice_number"))},
        "issue_date": {1: "31/02/2026", 6: absent, 23: "2027-01-01", 27: F.replace(c("issue_date"), F.lit("-")),
                       28: iso_week, 29: "2026-6-1"},
        "payment_date": {2: "2026-13-01", 13: absent, 23: "2027-01-15",
                         24: F.date_sub("issued", 1).cast("string"),
                         25: F.date_add("issued", c("terms") + 1).cast("string"),
                         26: "1990-01-01", 39: None},
        "payment_terms_days": {4: "Net 30", 13: absent, 23: "14", 24: None,
                               32: F.concat(F.lit("  "), c("payment_terms_days"), F.lit(" ")),
                               33: F.concat(c("payment_terms_days"), F.lit(".0")), 40: None, 42: "999999999999"},
        "amount": {3: "not-a-number", 7: absent, 19: (price * 10).cast("decimal(18,2)").cast("string"),
                   34: F.concat(F.lit("-"), c("amount")), 35: "0.05", 36: "1234.125",
                   37: F.concat(c("amount"), F.lit("0")), 41: "NaN"},
        "currency": {12: absent, 22: F.lower("currency"), 26: "zl", 31: "   "},
        "tax_id": {9: absent, 18: "TAX9", 26: None},
        "account": {8: absent, 17: "9999999999", 20: UNLISTED_IBAN, 21: BROKEN_IBAN, 38: "-"},
    }
    return clean.select("path", "k", *[_by_bucket(c(f), cases[f]).alias(f) for f in FIELDS])


def page_table(clean: DataFrame) -> DataFrame:
    """(path, page_no, text): lines 1–3, an empty page, lines 4–6; none for bucket 47."""
    k, price = F.col("k"), F.col("price")
    grouped = F.format_number(price, 2)
    layout = (
        F.when(k % 4 == 0, price.cast("string"))
        .when(k % 4 == 1, grouped)
        .when(k % 4 == 2, F.translate(grouped, ",.", ".,"))
        .otherwise(F.translate(grouped, ",.", NBSP + ","))
    )
    plain = price.cast("string")
    underlined = F.concat(
        F.lit("___"),
        F.regexp_replace(F.substring_index(plain, ".", 1), "([0-9])", "$1_"),
        F.lit(",_"),
        F.substring_index(plain, ".", -1),
        F.lit("_"),
    )
    number = _by_bucket(layout, {30: underlined, 35: "0.05", 36: "1234.12"})
    account = _by_bucket(F.col("account"), {20: UNLISTED_IBAN, 21: BROKEN_IBAN})
    spaced = F.when(k % 2 == 1, F.regexp_replace(account, "(.{4})(?=.)", "$1 ")).otherwise(account)
    first = F.concat_ws("\n", "company_name", "company_address", F.concat(F.lit("Invoice "), "invoice_number"))
    third = F.concat_ws(
        "\n",
        F.concat(F.lit("Total "), number, F.lit(" "), "currency"),
        F.concat(F.lit("Account "), spaced),
        F.concat(F.lit("Tax "), "tax_id"),
    )
    texts = F.array(
        F.when(_bucket() == 14, " \n\t").otherwise(first),
        F.lit(""),
        F.when(_bucket() == 14, NBSP).otherwise(third),
    )
    return (
        clean.filter(_bucket() != 47)
        .select("path", F.posexplode(texts).alias("pos", "text"))
        .select("path", (F.col("pos") + 1).cast("bigint").alias("page_no"), "text")
    )


def response_table(faulty: DataFrame) -> DataFrame:
    """(path, output_text): the record as JSON with its nulls; malformed in the buckets that say so."""
    body = F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})
    text = _by_bucket(
        body,
        {
            43: F.left(body, F.length(body) - 1),
            44: F.concat(F.left(body, F.length(body) - 1), F.lit(',"vat_rate":"23"}')),
            45: F.regexp_replace(body, r'"amount":"([0-9.]+)"', '"amount":$1'),
        },
    )
    return faulty.filter(_bucket() != 46).select("path", text.alias("output_text"))


def edit_log(clean: DataFrame) -> DataFrame:
    """(path, field, seq, op, text): three entries for every seventh document."""
    k = F.col("k")

    def entry(field, seq, op, text):
        return F.struct(
            F.lit(field).alias("field"), F.lit(seq).cast("bigint").alias("seq"),
            F.lit(op).alias("op"), text.cast("string").alias("text"),
        )

    third = F.when(
        k % 2 == 0, entry("invoice_number", 3, "revert", F.lit(None))
    ).otherwise(entry("amount", 3, "edit", F.lit(" 5.00 ")))
    entries = F.array(
        entry("invoice_number", 1, "edit", F.concat(F.lit("WRONG-"), k.cast("string"))),
        entry("currency", 2, "edit", F.lit("   ")),
        third,
    )
    return clean.filter(k % 7 == 0).select("path", F.inline(entries))


_FOLDERS: dict[tuple[str, str, str], str] = {}
_WRITTEN: set[str] = set()


class Documents:
    """The derived tables of one data folder, each written to the shared folder when it is first read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, shared_folder(spark), sf_dir)
        if key not in _FOLDERS:
            _FOLDERS[key] = work_folder(spark, "documents")
        self.folder = _FOLDERS[key]
        self.clean = self._kept("clean", lambda: clean_records(spark, sf_dir), spark)
        self.files = self.clean.select("path")

    def _kept(self, name: str, build, spark: SparkSession | None = None) -> DataFrame:
        folder = f"{self.folder}/{name}"
        if folder not in _WRITTEN:
            build().write.mode("overwrite").parquet(folder)
            _WRITTEN.add(folder)
        return (spark or self.clean.sparkSession).read.parquet(folder)

    @property
    def faulty(self) -> DataFrame:
        return self._kept("faulty", lambda: faulty_records(self.clean))

    @property
    def pages(self) -> DataFrame:
        return self._kept("pages", lambda: page_table(self.clean))

    def page_rows(self) -> DataFrame:
        """The pages from where they are stored, else as they are made from the records."""
        if f"{self.folder}/pages" in _WRITTEN:
            return self.pages
        return page_table(self.clean)

    @property
    def responses_folder(self) -> str:
        self._kept("responses", self._response_rows)
        return f"{self.folder}/responses"

    @property
    def edits_folder(self) -> str:
        self._kept("edits", lambda: edit_log(self.clean))
        return f"{self.folder}/edits"

    @property
    def responses(self) -> DataFrame:
        return self._kept("responses", self._response_rows)

    def _response_rows(self) -> DataFrame:
        return response_table(faulty_records(self.clean))

    def response_rows(self) -> DataFrame:
        """The responses from where they are stored, else as they are made from the records."""
        return self.responses if f"{self.folder}/responses" in _WRITTEN else self._response_rows()

    @property
    def edits(self) -> DataFrame:
        return self._kept("edits", lambda: edit_log(self.clean))

    def first_verdicts(self, keep_pages: bool = True) -> DataFrame:
        """The documents' first verdicts as an earlier run has stored them."""
        return self._kept(
            "verdicts",
            lambda: verify_documents(self.files, self.pages if keep_pages else self.page_rows(), self.responses, REF_DATE),
        )
