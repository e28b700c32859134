"""Connected components of an edge table, by alternating star operations.

Each round hangs the neighbours of a node below the smallest node it knows
(large star: the greater neighbours; small star: the others), so paths shorten
by a constant factor (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014). Rounds are aggregations and joins on node keys: no component is
ever in one task, and each round is saved, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import large
from ..functions.lineage import discard, saved


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``u, v, m``: the edges with the least neighbour of ``u``.

    The key is wrapped, so that the aggregate's own dealing by ``u`` does not
    serve the join: both sides are then plain exchanges, of which Spark splits
    the one that holds a node with very many edges.
    """
    a, b = edges.select(F.struct("u").alias("k"), "u", "v"), least.select(F.struct("u").alias("k"), "m")
    return a.join(large(b), "k").select("u", "v", "m")


def _hung(edges: DataFrame, large: bool) -> DataFrame:
    """edges: ``u, v`` with v != u. Large: all edges, both ways; small: v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        moved = _met(edges.filter("v > u"), least.withColumn("m", F.least("u", "m"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = _met(edges, least).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, component``: each node of an edge, with the smallest node it is connected to.

    Nodes are of any ordered type. Loops and repeated edges do no harm; an edge
    with a null end is dropped; nodes without edges to others do not occur.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNull() | F.col(b).isNull()).toDF("u", "v", "n")
    e, state = saved(e.filter("not n and u != v").select("u", "v").distinct()), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        before, e = e, saved(_hung(_hung(both, True), False))
        discard(before)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def spanning_forest(edges: DataFrame, a: str = "src", b: str = "dst", weight: str = "w", max_rounds: int = 60) -> DataFrame:
    """``src, dst, w``: a minimum spanning forest, by Boruvka's rounds.

    In each round every component takes its lightest edge to another (ties by the
    edge's ends, so no circle closes), components that are tied become one, and
    edges inside one go. So there are at most as many rounds as a component
    can double, and edges at least halve their components.
    """
    u, v = F.least(a, b).alias("u"), F.greatest(a, b).alias("v")
    e = edges.filter(F.col(a) != F.col(b)).groupBy(u, v).agg(F.min(weight).alias("w")).select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv"))
    e, forest = saved(e), None
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        ends = e.select(F.explode(F.array("cu", "cv")).alias("c"), F.struct("w", "u", "v", "cu", "cv").alias("edge"))
        chosen = saved(ends.groupBy("c").agg(F.min("edge").alias("edge")).select("edge.*").distinct())
        forest = chosen.select("u", "v", "w") if forest is None else forest.unionByName(chosen.select("u", "v", "w"))
        now = saved(connected_components(chosen, "cu", "cv"))
        for c in ("cu", "cv"):
            e = e.join(large(now.select(F.col("node").alias(c), F.col("component").alias(f"{c}_"))), c).drop(c).withColumnRenamed(f"{c}_", c)
        e = saved(e.filter("cu != cv"))
    else:
        raise RuntimeError(f"the forest did not settle in {max_rounds} rounds")
    return (e.select("u", "v", "w") if forest is None else forest).toDF("src", "dst", "w")
