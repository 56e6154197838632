"""Connected components of an edge table by alternating star contraction.

Each round is two relational steps. The large star hangs every larger
neighbour of a node under the smallest one seen there; the small star does the
same for the smaller neighbours. Rounds are logarithmic in the longest chain,
nothing is gathered per component, and every round's edges are a table in the
shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.sources.scratch import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
    return moved.union(low.select("u", F.col("low").alias("v"))).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every node hangs under one other, which hangs under none."""
    below = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    above = edges.select(F.col("v").alias("top")).distinct()
    seen = below.join(above, F.col("u") == F.col("top"), "left").agg(F.max("n"), F.count("top")).first()
    return (seen[0] or 0) <= 1 and not seen[1]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Return (node, component): every node of an edge with the least node it reaches.

    Null ends and self-loops are no edges; repeated edges count once; an empty
    edge table gives an empty result. Raises if ``max_rounds`` is not enough,
    so a result is always whole.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    current = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _is_forest_of_stars(current):
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        after = materialize(_small_star(_large_star(current)), "edges")
        discard(current)
        current = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
