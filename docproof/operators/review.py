"""Review tables from verdicts. All but the summary and the list are row-local.

Rows come from arrays made one projection earlier, and by outer generators: what stands inside a
generator is not compiled, and one that is not outer has its input made twice, to filter empty ones.
No array here is empty.
"""

from pyspark.sql import DataFrame, functions as F

from docproof.operators.edits import is_edited
from docproof.schema import FIELDS
from docproof.sources.files import file_name

# Placeholders and glyphs of the review tables.
NO_VALUE = "—"
NO_ISSUES = "No issues found."
FAILED = "Processing failed"
GLYPHS = {"ok": "✓", "flagged": "⚠", "error": "✗"}


def issue_rows(results: DataFrame) -> DataFrame:
    """(path, pos, rule_no, severity, field, message): one row per issue, in order.

    A failed document has one error row, a clean one a single row that says so.
    """
    def placeholder(severity, field, message):
        return F.array(
            F.struct(
                F.lit(None).cast("int").alias("rule_no"), F.lit(severity).alias("severity"),
                F.lit(field).alias("field"), message.alias("message"),
            )
        )

    shown = (
        F.when(F.col("issues").isNull(), placeholder("error", NO_VALUE, F.coalesce("error", F.lit(FAILED))))
        .when(F.size("issues") == 0, placeholder("", "", F.lit(NO_ISSUES)))
        .otherwise(F.expr("transform(issues, i -> struct(i.rule_no, i.severity, i.field, i.message))"))
    )
    shown = results.select("path", shown.alias("shown"))
    return shown.select("path", F.posexplode_outer("shown").alias("pos", "i")).select("path", "pos", "i.*")


def _worst(field: str):
    """Worst severity among a field's issues; null without any."""
    return F.expr(
        f"case when exists(issues, i -> i.field = '{field}' and i.severity = 'error') then 'error' "
        f"when exists(issues, i -> i.field = '{field}') then 'warning' end"
    )


def field_severity(results: DataFrame) -> DataFrame:
    """(path, field, severity) for each field with issues; issues of the whole document have no row."""
    rated = F.array(*[F.struct(F.lit(f).alias("field"), _worst(f).alias("severity")) for f in FIELDS])
    rated = results.select("path", rated.alias("rated"))
    return rated.select("path", F.inline_outer("rated")).filter(F.col("severity").isNotNull())


def field_review(results: DataFrame) -> DataFrame:
    """(path, field_no, field, value, severity, edited): ten rows per document, one if it failed."""
    def row(no, field, value, severity, edited):
        return F.struct(
            F.lit(no).alias("field_no"), F.lit(field).alias("field"), value.alias("value"),
            severity.alias("severity"), edited.alias("edited"),
        )

    failed = F.array(
        row(0, "(error)", F.coalesce("error", F.lit(FAILED)), F.lit("error"), F.lit(False))
    )
    fields = F.array(
        *[
            row(no, f, F.coalesce(F.col("data")[f], F.lit(NO_VALUE)), _worst(f), is_edited(f))
            for no, f in enumerate(FIELDS, 1)
        ]
    )
    rows = results.select("path", F.when(F.col("data").isNull(), failed).otherwise(fields).alias("rows"))
    return rows.select("path", F.inline_outer("rows"))


def run_summary(results: DataFrame, run_id: str) -> DataFrame:
    """One row: processed in this run, and loaded, flagged and failed over all runs."""
    return results.agg(
        F.count_if(F.col("run_id") == run_id).alias("processed"),
        F.count(F.lit(1)).alias("loaded"),
        F.count_if(F.col("status") == "flagged").alias("flagged"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def run_counts(results: DataFrame) -> DataFrame:
    """(loaded, flagged, errors) of one run's verdicts: the partial sums that ``summary_of_runs`` adds up."""
    return results.agg(
        F.count(F.lit(1)).alias("loaded"),
        F.count_if(F.col("status") == "flagged").alias("flagged"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def summary_of_runs(counts: DataFrame, run_id: str) -> DataFrame:
    """The row of ``run_summary`` from the stored counts of all runs, without reading any verdict."""
    own = F.when(F.col("run_id") == run_id, F.col("loaded")).otherwise(0)
    return counts.agg(
        F.coalesce(F.sum(own), F.lit(0)).alias("processed"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("loaded", "flagged", "errors")],
    )


def review_list(results: DataFrame) -> DataFrame:
    """(run_id, path, glyph, name) in order of arrival: by run, then as the files are listed."""
    glyph = F.col("status")
    for state, sign in GLYPHS.items():
        glyph = F.when(F.col("status") == state, sign).otherwise(glyph)
    # Dealt out before the sort, which first samples its input to find ranges: else every verdict is made twice.
    dealt = results.select("run_id", "path", glyph.alias("glyph")).repartition("path")
    return dealt.withColumn("name", file_name(F.col("path"))).orderBy("run_id", F.lower("name"), "path")
