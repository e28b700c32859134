"""The single-linkage tree of a spanning forest, as tables, and the density clusters in it.

The tree's inner nodes are the forest's edges, numbered from light to heavy. They
are put into chains by contracting every node's lightest edge, round by round: an
edge that lies inside a contracted node and is lighter than all edges out of it
belongs to the chain of that node, and the chain hangs from the lightest edge out
of it. Inside a chain, each edge is the parent of the next lighter one. So a tree
of any depth is known after a logarithmic number of rounds, sizes are sums along
chains, and clusters are stretches of them; no task holds a tree or a chain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import discard, saved
from ..functions.prefix import running_sums
from .components import connected_components

ROUNDS = 64


def chains(forest: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``r, w, round, level, c, top`` of each edge, ``node, r`` of each node, and the number of levels.

    ``r``: the edge's number from light to heavy, ties by its ends; ``level, c``: its
    chain; ``top``: the edge from which the chain hangs, null for a root's. Of nodes,
    ``r`` is the edge from which it hangs. forest: ``src, dst, w``, without circles.
    """
    ends = forest.select("w", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    edges = running_sums(ends.withColumn("one", F.lit(1)), ["w", "u", "v"], "one").select("w", F.col("_index").alias("r"), F.col("u").alias("cu"), F.col("v").alias("cv"))
    edges, nodes, pending, done = saved(edges), None, None, []
    level = 0
    while not edges.isEmpty():
        out = edges.select(F.explode(F.array("cu", "cv")).alias("c"), "r").groupBy("c").agg(F.min("r").alias("light"))
        out = saved(out)
        if nodes is None:
            nodes = out.select(F.col("c").alias("node"), F.col("light").alias("r"))
        chosen = edges.join(out.select(F.col("light").alias("r")).distinct(), "r")
        to = saved(connected_components(chosen, "cu", "cv"))
        inner = chosen.select("r", "w", F.lit(level).alias("round"), F.col("cu").alias("c"))
        if pending is not None:
            met = pending.join(out, "c")
            done.append(saved(met.filter("r < light").select("r", "w", "round", F.lit(level).alias("level"), "c", F.col("light").alias("top"))))
            inner = inner.unionByName(met.filter("r > light").select("r", "w", "round", "c"))
        pending = saved(inner.join(to.toDF("c", "to"), "c").select("r", "w", "round", F.col("to").alias("c")))
        left = edges.join(chosen.select("r"), "r", "left_anti")
        for c in ("cu", "cv"):
            left = left.join(to.toDF(c, "to"), c).drop(c).withColumnRenamed("to", c)
        before, edges = edges, saved(left.select("w", "r", "cu", "cv"))
        discard(before)
        # Trees without an edge left are roots: all that is pending there is their chain.
        live = edges.select(F.explode(F.array("cu", "cv")).alias("c")).distinct()
        level += 1
        root = pending.join(live, "c", "left_anti")
        done.append(saved(root.select("r", "w", "round", F.lit(level).alias("level"), "c", F.lit(None).cast("long").alias("top"))))
        pending = saved(pending.join(live, "c", "left_semi"))
        if level > ROUNDS:
            raise RuntimeError("the forest has circles")
    if nodes is None:
        kind = forest.schema["src"].dataType.simpleString()
        spark = forest.sparkSession
        return spark.createDataFrame([], f"r long, w double, round int, level int, c {kind}, top long"), spark.createDataFrame([], f"node {kind}, r long"), 0
    return saved(reduce(DataFrame.unionByName, done)), nodes, level


def sized(edges: DataFrame, nodes: DataFrame, levels: int, least: int) -> DataFrame:
    """The edges with ``size`` (nodes below), ``small`` and ``large`` (of its two sides), ``name``: the
    cluster that its component is, if of ``least`` nodes or more, and ``under``, the large side's name.

    A cluster is called by the edge that makes it: one whose sides are both clusters
    (``split``), or the first of a component that is large enough.
    """
    hung = nodes.groupBy("r").agg(F.count("*").alias("sum"), F.max(F.lit(1)).alias("most"), F.count("*").alias("sides"), F.lit(None).cast("long").alias("known"))
    out = []
    for level in range(1, levels + 1):
        own = edges.filter(F.col("level") == level).join(hung, "r")
        placed = running_sums(own.select("level", "c", "r", "w", "round", "top", "sum", "most", "sides", "known"), ["level", "c", "r"], "sum", ["level", "c"])
        below = F.when(F.col("sides") == 2, F.col("sum") - F.col("most")).otherwise(F.col("_before"))
        side = F.when(F.col("sides") == 2, F.col("most")).otherwise(F.col("sum"))
        placed = placed.withColumns({"size": F.col("_before") + F.col("sum"), "small": F.least(below, side), "large": F.greatest(below, side)}).drop("_before", "_index")
        makes = (F.col("size") >= least) & ((F.col("small") >= least) | (F.col("large") < least))
        # What comes in from the side, and is larger than what the chain has below, brings its name.
        brings = ~makes & (F.col("large") >= least) & ((F.col("sides") == 2) | (side >= least))
        placed = placed.withColumn("event", F.when(makes, F.col("r")).when(brings, F.col("known"))).withColumn("is_event", F.col("event").isNotNull().cast("long"))
        placed = saved(placed)
        numbered = running_sums(placed.select("level", "c", "r", "is_event"), ["level", "c", "r"], "is_event", ["level", "c"]).select("level", "c", "r", (F.col("_before") + F.col("is_event")).alias("k"), F.col("_before").alias("k_below"))
        numbered = saved(placed.join(numbered, ["level", "c", "r"]))
        names = numbered.filter("is_event = 1").select("level", "c", "k", F.col("event").alias("name"))
        told = numbered.join(names, ["level", "c", "k"], "left").join(names.withColumnsRenamed({"k": "k_below", "name": "below"}), ["level", "c", "k_below"], "left")
        told = saved(told.select("level", "c", "r", "w", "round", "top", "size", "small", "large", "sides", "name", "below", (F.col("small") >= least).alias("split")))
        out.append(told)
        tops = told.filter("top is not null").groupBy("level", "c", "top").agg(F.max("size").alias("size"), F.max_by("name", "r").alias("name"))
        more = tops.groupBy(F.col("top").alias("r")).agg(F.sum("size").alias("sum"), F.max("size").alias("most"), F.count("*").alias("sides"), F.max_by("name", F.struct("size", "c")).alias("known"))
        hung = saved(hung.unionByName(more).groupBy("r").agg(F.sum("sum").alias("sum"), F.max("most").alias("most"), F.sum("sides").alias("sides"), F.max_by("known", F.struct("most", F.col("known").isNotNull())).alias("known")))
    return saved(reduce(DataFrame.unionByName, out))


def entries(edges: DataFrame, levels: int, least: int) -> DataFrame:
    """``r, at``: of each edge, the first at or above it whose component has ``least`` nodes; those without are left out."""
    big = edges.filter(F.col("size") >= least)
    first = big.groupBy("level", "c").agg(F.min("r").alias("first"))
    chain = edges.groupBy("level", "c").agg(F.first("top").alias("top")).join(first, ["level", "c"], "left")
    settled = chain.filter("first is not null").select("level", "c", F.col("first").alias("at"))
    for level in range(levels, 0, -1):
        up = chain.filter((F.col("level") == level) & F.col("first").isNull() & F.col("top").isNotNull()).select("level", "c", F.col("top").alias("r"))
        met = up.join(edges.select("r", "size", F.col("level").alias("l2"), F.col("c").alias("c2")), "r")
        above = settled.select(F.col("level").alias("l2"), F.col("c").alias("c2"), F.col("at").alias("above"))
        got = met.join(above, ["l2", "c2"], "left").select("level", "c", F.when(F.col("size") >= least, F.col("r")).otherwise(F.col("above")).alias("at")).filter("at is not null")
        settled = saved(settled.unionByName(got))
    return edges.join(settled, ["level", "c"]).select("r", F.when(F.col("size") >= least, F.col("r")).otherwise(F.col("at")).alias("at"))


def cluster_tree(edges: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """``name, parent, size, stability`` of each cluster; ``parent``: the one it is split from.

    Stability is the sum over a cluster's nodes of 1/w where the node leaves it
    (or it is split), less 1/w where the cluster ends upward; a root ends at its
    heaviest edge.
    """
    big = edges.filter(F.col("size") >= least)
    inverse = lambda c: 1 / F.greatest(F.col(c), F.lit(1e-12))
    lost = big.select("name", F.when(F.col("r") == F.col("name"), F.col("size")).otherwise(F.col("small")).alias("n"), "w", "r", "size")
    held = lost.groupBy("name").agg(F.sum(F.col("n") * inverse("w")).alias("mass"), F.max("size").alias("size"), F.max_by("w", "r").alias("last_w"), F.max("r").alias("last"))
    # The edge above a cluster's last one: the next heavier in its chain, or what the chain hangs from.
    splits = big.filter("split").select("r", "w", "level", "c", "below", "sides")
    direct = splits.filter("sides = 1 and below is not null").select(F.col("below").alias("name"), F.col("r").alias("parent"), F.col("w").alias("parent_w"))
    tops = edges.filter("top is not null").groupBy("level", "c", "top").agg(F.max_by("name", "r").alias("name")).filter("name is not null")
    hanging = tops.join(splits.select(F.col("r").alias("top"), "w"), "top").select("name", F.col("top").alias("parent"), F.col("w").alias("parent_w"))
    above = direct.unionByName(hanging)
    out = held.join(above, "name", "left")
    return out.select("name", "parent", "size", (F.col("mass") - F.col("size") * inverse("parent_w")).alias("s"), "mass", "last_w").select("name", "parent", "size", F.coalesce("s", F.col("mass") - F.col("size") * inverse("last_w")).alias("stability"))


def best_sums(tree: DataFrame) -> DataFrame:
    """``name, best``: the greater of a cluster's stability and the sum of its children's ``best``.

    Clusters whose children are known are taken off in rounds. One that waits for a
    single child is a function of it, max(a, b + x); runs of such are composed by
    doubling, so a tree of any depth takes few rounds.
    """
    links = saved(tree.filter("parent is not null").select("name", "parent"))
    kids = links.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("waits"))
    state = saved(tree.join(kids, "name", "left").select("name", F.col("stability").alias("a"), F.lit(0.0).alias("b"), F.coalesce("waits", F.lit(0)).alias("waits")))
    best = saved(state.filter("waits = 0").select("name", F.col("a").alias("best")))
    fresh, state, runs = best, saved(state.filter("waits > 0")), None
    for _ in range(ROUNDS):
        if state.isEmpty() and (runs is None or runs.isEmpty()):
            return best
        told = links.join(fresh, "name").groupBy(F.col("parent").alias("name")).agg(F.sum("best").alias("add"), F.count("*").alias("n"))
        state = state.join(told, "name", "left").select("name", "a", (F.col("b") + F.coalesce("add", F.lit(0.0))).alias("b"), (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"))
        state = saved(state)
        known = saved(state.filter("waits = 0").select("name", F.greatest("a", "b").alias("best")))
        one = state.filter("waits = 1").select("name", "a", "b")
        open_ = links.join(best, "name", "left_anti").select(F.col("name").alias("next"), F.col("parent").alias("name"))
        new = one.join(open_, "name").select("name", "next", "a", "b")
        best = saved(best.unionByName(known))
        runs = _composed(new if runs is None else runs.unionByName(new))
        hit = saved(runs.join(best.toDF("next", "end"), "next").select("name", F.greatest("a", F.col("b") + F.col("end")).alias("best")))
        runs = saved(runs.join(hit, "name", "left_anti"))
        best, fresh, state = saved(best.unionByName(hit)), known.unionByName(hit), saved(state.filter("waits > 1"))
    raise RuntimeError("the tree of clusters has circles")


def _composed(runs: DataFrame) -> DataFrame:
    """Runs of functions ``name -> max(a, b + next)`` put together, each as far down as there are any."""
    runs = saved(runs)
    for _ in range(ROUNDS):
        met = runs.join(runs.toDF("next", "next2", "a2", "b2"), "next", "left")
        if met.filter("next2 is not null").isEmpty():
            return runs
        further = F.when(F.col("next2").isNotNull(), F.greatest("a", F.col("b") + F.col("a2"))).otherwise(F.col("a"))
        runs = saved(met.select("name", F.coalesce("next2", "next").alias("next"), further.alias("a"), (F.col("b") + F.coalesce("b2", F.lit(0.0))).alias("b")))
    raise RuntimeError("the tree of clusters has circles")


def chosen(tree: DataFrame, selection: str) -> DataFrame:
    """``name, cluster``: of each cluster, the chosen one that it is or lies in, null if none.

    ``leaf``: clusters without children. ``eom``: those at least as stable as the best
    choice below them, the uppermost on each way.
    """
    parents = tree.filter("parent is not null").select(F.col("parent").alias("name"))
    if selection == "leaf":
        own = tree.join(parents.distinct().withColumn("inner", F.lit(True)), "name", "left").withColumn("own", F.col("inner").isNull())
    elif selection == "eom":
        best = best_sums(tree)
        below = tree.join(best, "name").filter("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.sum("best").alias("below"))
        own = tree.join(below, "name", "left").withColumn("own", F.col("below").isNull() | (F.col("stability") >= F.col("below")))
    else:
        raise ValueError(f"unknown selection {selection!r}")
    state = saved(own.select("name", F.col("parent").alias("up"), F.when(F.col("own"), F.col("name")).alias("cluster")))
    for _ in range(ROUNDS):
        if state.filter("up is not null").isEmpty():
            return state.select("name", "cluster")
        above = state.toDF("up", "up2", "cluster2")
        before, state = state, saved(state.join(above, "up", "left").select("name", F.col("up2").alias("up"), F.coalesce("cluster2", "cluster").alias("cluster")))
        discard(before)
    raise RuntimeError("the tree of clusters has circles")


def forest_clusters(forest: DataFrame, least: int, selection: str = "eom") -> DataFrame:
    """``node, cluster``: the chosen cluster of each node of a forest ``src, dst, w``; nodes of none are left out."""
    edges, nodes, levels = chains(forest)
    edges = sized(edges, nodes, levels, least) if levels else edges.withColumns({"size": F.lit(0), "name": F.lit(0).cast("long")})
    if edges.filter(F.col("size") >= least).isEmpty():
        return nodes.select("node", F.col("r").alias("cluster")).limit(0)
    told = chosen(saved(cluster_tree(edges, nodes, least)), selection).filter("cluster is not null")
    at = entries(edges, levels, least).join(edges.select(F.col("r").alias("at"), "name"), "at").select("r", "name")
    return nodes.join(at, "r").join(told, "name").select("node", "cluster")
