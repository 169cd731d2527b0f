"""Document text from a page table (path, page_no, text).

Pages are ordered by number and then by text; pages without a number come first.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

# More characters than this of one document are never held in one row, but cut into blocks.
MAX_CHARS = 16_000_000
BLOCK_CHARS = 1_000_000
PAGES_PER_RANGE = 1_000


def joined_text() -> Column:
    """Aggregate: texts of the non-empty pages of a group, in page order, with line feeds between."""
    page = F.when(F.col("text") != "", F.struct("page_no", "text"))
    return F.array_join(F.sort_array(F.collect_list(page))["text"], "\n")


def join_pages(pages: DataFrame, *keys: str) -> DataFrame:
    """Texts of the non-empty pages of a group."""
    return pages.groupBy(*keys).agg(joined_text().alias("raw_text"))


def range_of(page_no: Column) -> Column:
    """Which range of page numbers a page belongs to; pages without a number form the first."""
    return F.coalesce(F.floor(page_no / PAGES_PER_RANGE), F.lit(-(1 << 62)))


def beyond_first_range(page_no: Column) -> Column:
    """Whether a page belongs to another range than 0, in a form that file statistics can answer."""
    return page_no.isNull() | (page_no < 0) | (page_no >= PAGES_PER_RANGE)


def block_of(keys: list[str], max_chars: int = MAX_CHARS, block_chars: int = BLOCK_CHARS) -> Column:
    """The block of a page in its group of pages; null where the group is short enough to be one row.

    Groups of more than ``max_chars`` characters are cut between pages, about every ``block_chars``.
    """
    in_order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("page_no"), "text")
    size = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    total = F.sum(size).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.coalesce(F.sum(size).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return F.when(total > max_chars, F.floor(before / block_chars).cast("bigint"))


def running_totals(pages: DataFrame, sizes: list[str], page_range: Column | None = None) -> DataFrame:
    """Add ``<size>_before``: the total over all earlier pages of the document.

    Totals per range of page numbers come first, so no window ever holds more than one range of
    pages, or one small row per range.
    """
    ranged = pages.withColumn("_range", range_of(F.col("page_no")) if page_range is None else page_range)
    earlier = Window.partitionBy("path").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("path", "_range")
        .agg(*[F.sum(s).alias(s) for s in sizes])
        .select("path", "_range", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_{s}_start") for s in sizes])
    )
    within = (
        Window.partitionBy("path", "_range")
        .orderBy(F.asc_nulls_first("page_no"), "text")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = {f"{s}_before": F.col(f"_{s}_start") + F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sizes}
    return (
        ranged.join(starts, ["path", "_range"])
        .withColumns(totals)
        .drop("_range", *[f"_{s}_start" for s in sizes])
    )


def assemble_text(pages: DataFrame, part_chars: int = MAX_CHARS) -> DataFrame:
    """(path, part_no, raw_text): the whole text of every document, page by page.

    Every document comes in parts of about ``part_chars`` characters, cut between pages; ordinary
    documents are part 0 alone. The parts in order, joined by line feeds, are the document.
    """
    sized = pages.withColumn("_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))
    part = F.floor(F.col("_chars_before") / part_chars).cast("bigint")
    return join_pages(running_totals(sized, ["_chars"]).withColumn("part_no", part), "path", "part_no")
