"""Connected components of a large graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.sources.shared import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """u with m, the smallest of its neighbours v and itself; combined inside each task first."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(down)
    return (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))))


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node of a link (a, b).

    Large-star and small-star steps in turn; each keeps at most one link per node and neighbour, and
    a node with very many links is combined by partial minima and a join that Spark can split.
    Every step is stored, so a lost executor costs one step.  Links of a node to itself, NULLs and
    repeated links are left out; without links there are no rows.
    """
    edges = stored(links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
                   .where("u <> v").distinct(), "links")
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = print_of(edges)
    while True:
        edges = stored(_small_star(_large_star(edges).distinct()).where("u <> v").distinct(), "links")
        found = print_of(edges)
        if found == seen:
            break
        seen = found
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
