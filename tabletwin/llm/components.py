"""Connected components of an undirected edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, written to the shared folder; nothing is gathered on the driver but
two numbers a step. No step has more than twice the edges of the one before, so each is written in as many files as these
need. A node with very many neighbours is aggregated before the shuffle, and joins on it can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletwin.llm.store import in_fewer_files, written

MAX_STEPS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b): neighbours move to the least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    if not large:
        both = both.where(F.col("v") < F.col("u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.join(least, "u")
    if large:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("x"), F.col("m").alias("y"))
    else:
        out = moved.select(F.col("v").alias("x"), F.col("m").alias("y")).union(least.select(F.col("u"), F.col("m")))
    return out.where(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the component is its least node."""
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark, rows = None, now.count()
    for _ in range(MAX_STEPS):
        # each step is written: a step over another that is not would plan it once for every use
        large = written(in_fewer_files(_star(now, large=True), rows), "edges")
        now = written(in_fewer_files(_star(large, large=False), 2 * rows), "edges")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark, rows = tuple(new), new[0]
    else:
        raise RuntimeError("components did not settle")
    # every edge now leads from a node to the least node of its component
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
    return in_fewer_files(found, 2 * rows)
