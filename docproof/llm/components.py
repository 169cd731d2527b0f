"""Connected components of a link table by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame, functions as F

from docproof.llm.support import discard, join_hot, stored


def _settled(edges: DataFrame) -> bool:
    """Whether every larger node has one link, and that to a node which is nowhere the larger one."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("links"), F.lit(0).alias("centre")).unionAll(
        edges.select(F.col("lo").alias("node"), F.lit(0).alias("links"), F.lit(1).alias("centre"))
    )
    nodes = ends.groupBy("node").agg(F.sum("links").alias("links"), F.max("centre").alias("centre"))
    return nodes.agg(F.coalesce(F.max(F.col("links") + F.col("centre")), F.lit(0))).first()[0] <= 1


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionAll(
        edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
    )
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    larger = both.filter("other > node")
    return join_hot(larger, least, ["node"], "other").select(F.col("other").alias("hi"), F.col("least").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = join_hot(edges, least, ["hi"], "lo").filter("lo > least").select(F.col("lo").alias("hi"), "least")
    return least.unionAll(moved).select("hi", F.col("least").alias("lo")).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(id, component): every linked node with the smallest node that it reaches.

    Links are read as undirected; nulls and links of a node to itself are ignored, repeated links
    count once. Nodes without links are not returned. Each round is written to the shared folder
    and the round before removed, until all links are stars around smallest nodes; the number of
    rounds grows with the logarithm of the longest chain. Nodes with very many links are spread over tasks.
    """
    edges = stored(
        links.filter(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo"))
        .distinct(),
        "links",
    )
    while not _settled(edges):
        after = stored(_small_star(_large_star(edges).distinct()), "stars")
        discard(edges)
        edges = after
    roots = edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(roots)
