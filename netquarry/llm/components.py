"""Connected components of an edge table by alternating large-star and small-star steps.

Every round is a written table, and the one before it is removed; nothing is collected but one row of sums a round. Nodes
with very many edges are joined apart, so that no task gets a hub's edges together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.runtime import hot_above, join_parts, settled


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable."""
    spark = edges.sparkSession
    now = settled(spark, "stars", lambda: edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = _mark(now)
    for _ in range(max_rounds):
        if not before["edges"]:
            break
        now = settled(spark, "stars", lambda at=now, mark=before: _small_star(_large_star(at, mark)))
        mark = _mark(now)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("c"), F.col("v").alias("nbr")).unionByName(edges.select(F.col("v").alias("c"), F.col("u").alias("nbr")))


def _mark(edges: DataFrame):
    """Number and digest of the edges, and the largest number of edges of a node."""
    nodes = _both(edges).groupBy("c").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("c", "nbr")).alias("x"), F.sum(F.xxhash64("c", "nbr").cast("decimal(20,0)")).alias("s"))
    return nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.max("n").alias("most"), F.bit_xor(F.xxhash64("c", "x")), F.sum("s")).first()


def _large_star(edges: DataFrame, mark) -> DataFrame:
    """Each node hangs its larger neighbours under its smallest neighbour."""
    both = _both(edges)
    least = both.groupBy("c").agg(F.min("nbr").alias("least"), F.count("*").alias("rows")).select("c", F.least("c", "least").alias("m"), "rows")
    hot, rows = hot_above(mark["edges"]), both.where("nbr > c")
    joined = rows.join(least, "c") if mark["most"] <= hot else join_parts(rows, least.where(F.col("rows") > hot), least.where(F.col("rows") <= hot), ["c"])
    return joined.select(F.col("nbr").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hangs itself and its smaller neighbours under the smallest of them; these are few, a hub's neighbours are larger."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()
