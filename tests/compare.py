"""Run queries on Spark and their SQL on DuckDB and compare the rows."""

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf_dir) / t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(r[i] for i in order) for r in data), sorted(columns)


def difference(spark, con, name, run, sql, sf_dir):
    """None when equal, otherwise a short account of what differs."""
    df = run(spark, sf_dir)
    ours, our_columns = rows(df.columns, df.collect())
    answer = con.execute(sql)
    theirs, their_columns = rows([d[0] for d in answer.description], answer.fetchall())
    if our_columns != their_columns:
        return f"columns {our_columns} / {their_columns}"
    if ours != theirs:
        extra, lacking = ours - theirs, theirs - ours
        return (f"{sum(ours.values())} / {sum(theirs.values())} rows, {sum(extra.values())} only here: "
                f"{list(extra)[:3]}, {sum(lacking.values())} only there: {list(lacking)[:3]}")
    return None if ours else "no rows"
