"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one grouping of the edges; no node's neighbours are ever collected. The number of steps grows
with the logarithm of the longest path. Every step is written to the shared folder, which cuts the lineage.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.llm.storage import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour (large: those above the node; small: those below) to the node's least one."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    # read from files rather than from the same shuffle: the join can then split a node with very many edges
    least = materialize(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")
    if large:
        links = both.where("b > a").join(least, "a").select(F.col("b").alias("x"), "least")
    else:
        links = near.join(least, "a").select(F.col("b").alias("x"), "least").unionByName(least.select(F.col("a").alias("x"), "least"))
    return links.where("x != least").select(F.col("x").alias("b"), F.col("least").alias("a")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the least node of its component) for every node of ``edges`` (a, b: long).

    Loops and repeated edges don't count. An empty table gives an empty result.
    """
    current = materialize(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    digest = None
    while True:
        # a fixed point of both steps is a set of stars, each around its least node
        current = materialize(_star(_star(current, True), False), "stars")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == digest or not state[0]:
            break
        digest = state
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
