"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling, in SQL.

Token weights of the cells source x language x topic are raked until their sums over each axis meet
the targets. A cell's documents stay with the ratio of raked to given tokens, times the share of all
tokens that is asked for; cells whose ratio asks for more than they have stay whole. So no cell but
the own one decides on a document, and a stray row of a rare source moves nothing else.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from docproof.llm.support import few, free_name, stored

AXES = ["source", "lang", "topic"]
# What a text must contain to be of a topic; the first topic that fits counts.
TOPIC_MARKS = {"legal": ["icense", "opyright"], "contact": ["@"], "code": ["{", "();"]}
BRIEF_TOKENS = 100
TEMPER = 0.8
TOLERANCE = 1e-9
# Share of all tokens that the mixture asks for; what cells are too small to give is not made up for elsewhere.
KEEP = 0.75
# Up to so many cells are raked in one task and broadcast.
MOST_BROADCAST_CELLS = 100_000
ROUNDS_PER_STEP, MOST_STEPS = 5, 40


def token_count(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    found = F.when(tokens < BRIEF_TOKENS, "brief").otherwise("prose")
    for topic, marks in reversed(TOPIC_MARKS.items()):
        has = reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in marks])
        found = F.when(F.coalesce(has, F.lit(False)), topic).otherwise(found)
    return found


def _names(docs: DataFrame) -> dict[str, str]:
    """Names for the columns added on the way that the table does not have."""
    return {c: free_name(docs, f"_{c}") for c in [*AXES, "tokens", "probability", "kept"]}


def measured(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """Documents with their axis values and token count in columns of names of their own (``_names``)."""
    own = _names(docs)
    with_tokens = docs.withColumn(own["tokens"], token_count(F.col("text")))
    found = topic_of(F.col("text"), F.col(own["tokens"])) if topic is None else topic
    return with_tokens.withColumns({own["source"]: F.col("source"), own["lang"]: F.col("lang"), own["topic"]: found})


def tempered_targets(cells: DataFrame, axis: str, temper: float = TEMPER) -> DataFrame:
    """(axis, share): observed shares to the power ``temper``, scaled to 1; small values gain."""
    powers = cells.groupBy(axis).agg(F.sum("tokens").alias("_n")).filter("_n > 0").select(axis, F.pow("_n", F.lit(temper)).alias("_p"))
    total = powers.agg(F.sum("_p")).first()[0]
    return powers.select(axis, (F.col("_p") / F.lit(total or 1.0)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Cells with ``weight``: tokens raked to the target shares of every axis.

    Cells without tokens, and values whose target is missing or 0, get weight 0; the shares of the
    values that are there count in proportion. Rounds go on until every sum meets its target to one
    in 10**9; targets that contradict each other stop after 200 rounds at the last axis's targets.
    Up to ``MOST_BROADCAST_CELLS`` cells are raked in one task; more are dealt by the axis in turn.
    """
    frame = cells
    for axis, table in targets.items():
        share = table.select(F.col(axis).alias("_value"), F.col("share").alias(f"_share_{axis}"))
        frame = frame.join(share, frame[axis].eqNullSafe(share["_value"]), "left").drop("_value")
    known = reduce(Column.__and__, [F.coalesce(F.col(f"_share_{a}"), F.lit(0.0)) > 0 for a in targets])
    frame = stored(frame.withColumn("weight", F.when(known, F.col("tokens").cast("double")).otherwise(0.0)), "cells")
    small = few(frame, MOST_BROADCAST_CELLS)

    def gathered(df):
        return df.coalesce(1) if small else df

    # Shares of the values that have weight, scaled to 1, then as token sums.
    live = frame.filter("weight > 0")
    total = live.agg(F.sum("weight")).first()[0] or 0.0
    for axis in targets:
        counted = live.groupBy(axis).agg(F.max(f"_share_{axis}").alias("s")).agg(F.sum("s")).first()[0]
        frame = frame.withColumn(f"_goal_{axis}", F.col(f"_share_{axis}") / F.lit(counted or 1.0) * F.lit(total))
    for _ in range(MOST_STEPS):
        frame = gathered(frame)
        for _ in range(ROUNDS_PER_STEP):
            for axis in targets:
                now = F.sum("weight").over(Window.partitionBy(axis))
                frame = frame.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight") * F.col(f"_goal_{axis}") / now).otherwise(0.0))
        frame = stored(frame, "cells")
        gaps = gathered(frame.filter("weight > 0"))
        gaps = gaps.select(*[F.abs(F.sum("weight").over(Window.partitionBy(a)) / F.col(f"_goal_{a}") - 1).alias(f"_off_{a}") for a in targets])
        worst = gaps.agg(*[F.max(f"_off_{a}") for a in targets]).first()
        if all(w is None or w < TOLERANCE for w in worst):
            break
    return frame.select(*cells.columns, "weight")


def probabilities(cells: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP) -> DataFrame:
    """(source, lang, topic, tokens, probability): the share of each cell's documents to keep, at most 1."""
    goals = targets or {axis: tempered_targets(cells, axis) for axis in AXES}
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    chance = F.least(F.lit(1.0), F.round(ratio * F.lit(keep), 9))
    return rake(cells, goals).select(*AXES, "tokens", F.coalesce(chance, F.lit(0.0)).alias("probability"))


def reached(chances: DataFrame) -> DataFrame:
    """(axis, value, share, expected): each value's share of all tokens before, and of those that are expected to stay."""
    given, left = F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))
    totals = chances.agg(given, left).first()
    sums = [
        chances.groupBy(F.lit(axis).alias("axis"), F.col(axis).cast("string").alias("value"))
        .agg((given / F.lit(totals[0] or 1)).alias("share"), (left / F.lit(totals[1] or 1.0)).alias("expected"))
        for axis in AXES
    ]
    return reduce(DataFrame.unionByName, sums)


def cells_of(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """(source, lang, topic, tokens) of the cells that have documents."""
    own = _names(docs)
    groups = [F.col(own[a]).alias(a) for a in AXES]
    return measured(docs, topic).groupBy(*groups).agg(F.sum(own["tokens"]).alias("tokens"))


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, keep: float = KEEP) -> DataFrame:
    """Documents with source, language, topic, tokens, probability and draw in the columns of ``_names``.

    ``targets`` gives a table (axis, share) for each of source, lang and topic; without it observed
    shares are flattened (``tempered_targets``). ``topic`` is the topic of a document; without it a
    coarse one is read off the text (``topic_of``). ``keep`` is the share of all tokens asked for.

    Null axis values are values of their own. Documents without words count no tokens and follow
    their cell; a cell without any token has probability 0. The draw depends on doc_id alone, so
    repeated rows stay or go together and runs repeat; null ids draw as one. An empty table gives an
    empty result; other columns pass through, whatever their names.
    """
    own = _names(docs)
    rows = measured(docs, topic)
    chances = stored(probabilities(stored(cells_of(docs, topic), "cells"), targets, keep), "chances")
    cell = {a: free_name(rows, f"_cell_{a}") for a in AXES}
    chances = chances.select(*[F.col(a).alias(cell[a]) for a in AXES], F.col("probability").alias(own["probability"]))
    side = F.broadcast(chances) if few(chances, MOST_BROADCAST_CELLS) else chances
    on = reduce(Column.__and__, [rows[own[a]].eqNullSafe(side[cell[a]]) for a in AXES])
    hexadecimal = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8)
    draw = F.conv(hexadecimal, 16, 10).cast("double") / 2.0**32
    return rows.join(side, on).drop(*cell.values()).withColumn(own["kept"], draw < F.col(own["probability"]))


def mixture(docs: DataFrame, targets: dict[str, DataFrame] | None = None, **options) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, kept) of every document."""
    own = _names(docs)
    return mixed(docs, targets, **options).select(
        "doc_id", *[F.col(own[a]).alias(a) for a in AXES], F.col(own["tokens"]).alias("tokens"),
        F.round(own["probability"], 6).alias("probability"), F.col(own["kept"]).alias("kept"),
    )


def sample_to_targets(docs: DataFrame, targets: dict[str, DataFrame] | None = None, **options) -> DataFrame:
    """The documents that the draw keeps, with their own columns."""
    return mixed(docs, targets, **options).filter(F.col(_names(docs)["kept"])).select(*docs.columns)
