"""Connected components by alternating large-star and small-star, over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import save

#: Rounds after which an unsettled result is an error; the number needed grows with the logarithm of the longest path.
ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    """Every node joins its larger neighbours to the smallest node it sees."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    # A node with many neighbours makes a skewed join, which Spark splits at run time.
    return both.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node joins itself and its smaller neighbours to the smallest of them. Edges run from the larger (u) to the smaller (v)."""
    least = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
    moved = e.join(least, F.col("u") == F.col("c")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) to (id, component) for every id that has an edge and is not its component's smallest id.

    Edges with a null end and loops are left out. The state is one edge table,
    written to shared storage in each round; only its size and a checksum come
    to the driver.
    """
    e = edges.dropna(subset=[a, b]).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    e = save(e, "star")
    mark = None
    for _ in range(ROUNDS):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        e = save(_small_star(_large_star(e)), "star", instead_of=e)
    else:
        raise RuntimeError(f"components are not settled after {ROUNDS} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
