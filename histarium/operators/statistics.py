"""Statistics of clusters: means, markers, tests, composition, annotation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.lineage import saved
from ..functions.prefix import changes, counted, quantiles, runs
from ..functions.scalar import marker_name, stars
from ..functions.tails import normal_two_sided
from .correlation import adjust_p
from .scaling import melted, scale_mad, scale_zscore

#: Markers that tell no cell type: DNA and membrane stains, by part of the name. Fixed values.
NO_PHENOTYPE = ("DNA", "Ir191", "Ir193", "ICSK", "membrane")


def cluster_means(df: DataFrame, features: Sequence[str], cluster: str = "cluster", only: Sequence | None = None, scale: str | None = None) -> DataFrame:
    """Mean of each feature per cluster, by cluster; ``only``: shown groups;
    ``scale``: ``zscore`` or ``mad`` over the shown cells."""
    held = df if only is None else df.filter(F.col(cluster).isin(list(only)))
    if scale:
        held = {"zscore": scale_zscore, "mad": scale_mad}[scale](held, features)
    return held.groupBy(cluster).agg(*[F.avg(f"`{f}`").alias(f) for f in features]).orderBy(cluster)


def differential(df: DataFrame, features: Sequence[str], cluster: str = "cluster", top_n: int = 5) -> DataFrame:
    """``cluster, feature, mean, z, place``: the features that stand out most in a cluster.

    z is over the clusters' means, with the sample deviation; 0 counts as 1.
    """
    means = melted(df, features, [cluster]).groupBy(cluster, "feature").agg(F.avg("value").alias("mean"))
    over = Window.partitionBy("feature")
    sd = F.stddev_samp("mean").over(over)
    z = (F.col("mean") - F.avg("mean").over(over)) / F.when(sd > 0, sd).otherwise(1.0)
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(F.round("z", 9)), "feature"))
    return means.withColumn("z", z).withColumn("place", place).filter(F.col("place") <= top_n)


def marker_stats(df: DataFrame, features: Sequence[str], cluster: str = "cluster", top_k: int | None = None) -> DataFrame:
    """A row for each cluster and marker: z over cluster means, log2 fold change
    against the mean of the other clusters' means, AUROC, shares above 0 inside and
    outside, and range; with ``top_k``, the most raised and lowered of each cluster."""
    used = [f for f in features if not any(x.lower() in f.lower() for x in NO_PHENOTYPE)]
    # Saved, as means computed twice can differ in their last bits, and then find no rank.
    long = saved(melted(df, used, [cluster]).filter("value is not null"))
    # Values are counted by cluster, then ranked: each distinct value is met once.
    held = long.groupBy(cluster, "feature", "value").agg(F.count("*").alias("c"))
    steps = counted(long, ["feature"], "value").select("feature", "value", (F.col("_before") + (F.col("_n") + 1) / 2).alias("rank"))
    ranked = held.join(steps, ["feature", "value"])
    inside = ranked.groupBy(cluster, "feature").agg(
        (F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.sum("c").alias("n"), F.sum(F.when(F.col("value") > 0, F.col("c")).otherwise(0)).alias("pos"), F.sum(F.col("rank") * F.col("c")).alias("ranks"),
    )
    middle = quantiles(long.filter(F.col(cluster).isNotNull()), [cluster, "feature"], "value", [0.5]).select(cluster, "feature", F.col("q")[0].alias("median"))
    inside = inside.join(middle, [cluster, "feature"], "left")
    over = Window.partitionBy("feature")
    n_all, pos_all, k = F.sum("n").over(over), F.sum("pos").over(over), F.count("*").over(over)
    sd = F.stddev_samp("mean").over(over)
    rest = (F.sum("mean").over(over) - F.col("mean")) / (k - 1)
    out = inside.select(
        cluster, F.col("feature"), marker_name(F.col("feature")).alias("marker"), "mean", "median", "min", "max", (F.col("max") - F.col("min")).alias("range"), "n",
        ((F.col("mean") - F.avg("mean").over(over)) / F.when(sd > 0, sd).otherwise(1.0)).alias("z"),
        F.when(k > 1, F.log2((F.col("mean") + 1e-6) / (rest + 1e-6))).alias("log2_fold_change"),
        F.when(n_all > F.col("n"), (F.col("ranks") - F.col("n") * (F.col("n") + 1) / 2) / (F.col("n") * (n_all - F.col("n")))).alias("auroc"),
        (F.col("pos") / F.col("n")).alias("pct_in"), F.when(n_all > F.col("n"), (pos_all - F.col("pos")) / (n_all - F.col("n"))).alias("pct_out"),
    )
    if top_k is None:
        return out
    up = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(F.round("z", 9)), "feature"))
    down = F.row_number().over(Window.partitionBy(cluster).orderBy(F.round("z", 9), "feature"))
    return out.withColumn("up", up).withColumn("down", down).filter((F.col("up") <= top_k) | (F.col("down") <= top_k))


def phenotype_payload(stats: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``cluster, payload``: a JSON document per cluster for an outside annotator."""
    row = F.struct("marker", F.round("z", 3).alias("z"), F.round("log2_fold_change", 3).alias("log2_fold_change"), F.round("auroc", 3).alias("auroc"), F.round("pct_in", 3).alias("pct_in"), F.round("pct_out", 3).alias("pct_out"))
    held = stats.groupBy(cluster).agg(F.max("n").alias("n_cells"), F.array_sort(F.collect_list(row)).alias("markers"))
    return held.select(cluster, F.to_json(F.struct(F.col(cluster).alias("cluster"), "n_cells", "markers")).alias("payload"))


REPLY = "cluster string, phenotype string, confidence double, rationale string"


def phenotype_reply(replies: DataFrame, column: str = "reply") -> DataFrame:
    """An annotator's JSON replies as columns; ``valid`` tells whether cluster and phenotype are there."""
    parsed = replies.withColumn("_r", F.from_json(column, REPLY)).select("*", "_r.*").drop("_r")
    return parsed.withColumn("valid", F.col("cluster").isNotNull() & (F.coalesce(F.trim("phenotype"), F.lit("")) != ""))


#: Numbers of an array that a task makes of its rows and all groups.
SHARE = 1 << 20
#: Up to so many values in the smaller sample, and without ties, p is exact.
EXACT = 8


def mann_whitney(df: DataFrame, features: Sequence[str], group: str, mode: str = "pairwise", reference=None) -> DataFrame:
    """``feature, group_a, group_b, n_a, n_b, u, p, p_adjusted, stars``.

    Two-sided; exact where a sample has ``EXACT`` values at most and none is
    tied, otherwise normal with tie and continuity correction. ``mode``:
    ``pairwise`` or ``one_vs_rest`` (``reference`` against each other group).
    Groups of under two values are left out; Benjamini-Hochberg in each feature.
    Values are counted first and dealt out by a range sort; a task adds up what its
    range tells of all pairs of groups, so no pair gets rows of its own.
    """
    by = ["feature", "group_a", "group_b"]
    long = melted(df, features, [group]).filter(F.col("value").isNotNull() & F.col(group).isNotNull()).groupBy("feature", F.col(group).alias("g"), "value").agg(F.count("*").alias("c"))
    met = saved(_met_by_range(long, df.select(F.col(group).alias("g")).filter("g is not null").distinct().collect()))  # the names of the groups
    totals = met.filter("group_b is null").select("pid", "feature", F.col("group_a").alias("g"), "n", "ties")
    sizes = totals.groupBy("feature", "g").agg(F.sum("n").alias("n"), F.sum("ties").alias("t")).filter("n >= 2")
    pairs = sizes.toDF("feature", "group_a", "n_a", "t_a").join(sizes.toDF("feature", "group_b", "n_b", "t_b"), "feature")
    pairs = pairs.filter("group_a < group_b") if mode == "pairwise" else pairs.filter((F.col("group_a") == reference) & (F.col("group_b") != reference))
    # Values of the second group in earlier ranges are below all of the first's in a range.
    every = totals.select("feature", "pid").distinct().join(sizes.select("feature", "g"), "feature").join(totals.select("feature", "pid", "g", "n"), ["feature", "pid", "g"], "left")
    earlier = Window.partitionBy("feature", "g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    below = every.select("feature", "pid", F.col("g").alias("group_b"), F.sum("n").over(earlier).alias("m")).filter("m > 0")
    ahead = totals.select("feature", "pid", F.col("g").alias("group_a"), "n").join(below, ["feature", "pid"]).groupBy(*by).agg(F.sum(2 * F.col("n") * F.col("m")).alias("outer"))
    near = met.filter("group_b is not null").groupBy(*by).agg(F.sum("n").alias("inner"), F.sum("ties").alias("ties"))
    sums = pairs.join(near, by, "left").join(ahead, by, "left").select(
        *by, "n_a", "n_b", ((F.coalesce("inner", F.lit(0)) + F.coalesce("outer", F.lit(0))) / 2).alias("u"), (F.col("t_a") + F.col("t_b") + F.coalesce("ties", F.lit(0.0))).alias("ties")
    )
    n = F.col("n_a") + F.col("n_b")
    u = F.col("u")
    mean, var = F.col("n_a") * F.col("n_b") / 2, F.col("n_a") * F.col("n_b") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    z = F.greatest(F.abs(u - mean) - 0.5, F.lit(0.0)) / F.sqrt(var)
    out = sums.select(*by, "n_a", "n_b", "u", F.when(var > 0, z).alias("z"), ((F.least("n_a", "n_b") <= EXACT) & (F.col("ties") == 0)).alias("exact"))
    normal = F.when(F.col("z").isNull(), 1.0).otherwise(normal_two_sided(F.coalesce("z", F.lit(0.0))))
    out = out.withColumn("p", F.when(F.col("exact"), exact_p(F.col("u"), F.col("n_a"), F.col("n_b"))).otherwise(normal)).drop("exact")
    out = adjust_p(out, "fdr_bh", ["feature"])
    return out.withColumn("stars", stars(F.col("p_adjusted")))


def _met_by_range(long: DataFrame, names: list) -> DataFrame:
    """``pid, feature, group_a, group_b, n, ties`` of each range ``pid`` of ``long`` (``feature, g, value, c``).

    Of two groups, ``n`` is twice the first's U within the range, and ``ties`` what
    their common values add to the sum of c^3 - c; of one (``group_b`` null), its
    number of values and that sum.
    """
    kind = long.schema["g"].dataType
    shape = T.StructType([T.StructField("pid", T.IntegerType()), long.schema["feature"], T.StructField("group_a", kind), T.StructField("group_b", kind), T.StructField("n", T.LongType()), T.StructField("ties", T.DoubleType())])
    schema, k = to_arrow_schema(shape), len(names)
    groups = pa.array([r["g"] for r in names], schema.field("group_a").type)

    def add(state: tuple, g: np.ndarray, value: np.ndarray, c: np.ndarray) -> None:
        """Rows of whole values: group, number of the value from 0, count."""
        below, pairs, common, alone = state
        here = np.zeros((int(value[-1]) + 1, k), np.int64)
        here[value, g] = c
        ahead = np.cumsum(here, 0) - here + below
        below += here.sum(0)
        np.add.at(alone, g, c.astype(float) ** 3 - c)
        order = np.argsort(g, kind="stable")
        g, value, c = g[order], value[order], c[order, None]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        pairs[g[first]] += np.add.reduceat(c * (2 * ahead[value] + here[value]), first, 0)
        common[g[first]] += np.add.reduceat(3.0 * c * here[value] * (c + here[value]), first, 0)

    def told(pid: int, feature: str, state: tuple) -> pa.RecordBatch:
        below, pairs, common, alone = state
        a, b = np.nonzero((pairs != 0) | (common != 0))
        held = np.flatnonzero(below)
        n = len(a) + len(held)
        second = pa.concat_arrays([groups.take(pa.array(b)), pa.nulls(len(held), groups.type)])
        columns = [np.full(n, pid), [feature] * n, groups.take(pa.array(np.r_[a, held])), second, np.r_[pairs[a, b], below[held]], np.r_[common[a, b], alone[held]]]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    def whole(batches):
        """Batches that end with a value's last row."""
        rest = None
        for batch in batches:
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            last = np.flatnonzero(changes(batch, ["feature", "value"]))[-1:].sum()
            rest = batch.slice(last)
            if last:
                yield batch.slice(0, last)
        if rest is not None and rest.num_rows:
            yield rest

    def meet(batches):
        pid, feature, state = TaskContext.get().partitionId(), None, None
        for batch in whole(batches):
            g, c = pc.index_in(batch.column("g"), groups).to_numpy(zero_copy_only=False), batch.column("c").to_numpy()
            new = changes(batch, ["feature", "value"])
            for key, lo, hi in runs(batch, ["feature"]):
                if state is None or key != feature:
                    if state is not None:
                        yield told(pid, feature[0], state)
                    feature, state = key, (np.zeros(k, np.int64), np.zeros((k, k), np.int64), np.zeros((k, k)), np.zeros(k))
                starts = lo + np.flatnonzero(new[lo:hi])
                cuts = np.unique(starts[np.searchsorted(starts, np.arange(lo, hi, max(SHARE // k, 1)), "right") - 1])
                for i, j in zip(cuts, [*cuts[1:], hi], strict=True):
                    add(state, g[i:j], np.cumsum(new[i:j]) - 1, c[i:j])
        if state is not None:
            yield told(pid, feature[0], state)

    n = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return long.repartitionByRange(n, "feature", "value").sortWithinPartitions("feature", "value").mapInArrow(meet, shape)


def exact_p_value(u: float, n_a: int, n_b: int) -> float:
    """Two-sided p of a U without ties: twice the share of arrangements with a U at
    least as far out, 1 at most.

    The numbers of arrangements are the coefficients of a Gaussian binomial: for i
    from 1 to the smaller sample's size, 1 is multiplied by 1 - q^(n + i), n being
    the larger one's, and divided by 1 - q^i, as far as the power U.
    """
    m, n = sorted((int(n_a), int(n_b)))
    tail = int(min(u, n_a * n_b - u))
    ways = np.zeros(tail + 1)
    ways[0] = 1
    for i in range(1, m + 1):
        for r in range(min(i, tail + 1)):
            ways[r::i] = np.cumsum(ways[r::i])
        ways[n + i :] -= ways[: max(tail + 1 - n - i, 0)].copy()
    return min(2 * ways.sum() / math.comb(n + m, m), 1.0)


def exact_p(u: Column, n_a: Column, n_b: Column) -> Column:
    """``exact_p_value`` where a sample is small, else null; a row for each pair of groups and feature."""

    def told(u: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        return pd.Series([exact_p_value(x, a, b) if min(a, b) <= EXACT and x == int(x) else None for x, a, b in zip(u, n_a, n_b, strict=True)], dtype=float)

    return F.pandas_udf(told, "double")(u, n_a, n_b)


def composition(df: DataFrame, group: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """``group, cluster, n, share``: share of each cluster in each group, 0 where absent."""
    counts = df.groupBy(*group, cluster).agg(F.count("*").alias("n"))
    every = counts.select(*group).distinct().crossJoin(counts.select(cluster).distinct())
    held = every.join(counts, [*group, cluster], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(*group))
    return held.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def distribution_long(df: DataFrame, markers: Sequence[str], cluster: str = "cluster") -> DataFrame:
    return melted(df, markers, [cluster]).filter("value is not null")


def five_numbers(df: DataFrame, markers: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """``cluster, feature, n, min, q25, median, q75, max``; clusters that are null are one group."""
    long = distribution_long(df, markers, cluster).withColumn("_none", F.col(cluster).isNull())
    n = long.groupBy(cluster, "_none", "feature").agg(F.count("*").alias("n"))
    by = ["_none", cluster, "feature"]
    q = quantiles(long.filter("not _none"), by, "value", [0.0, 0.25, 0.5, 0.75, 1.0])
    if not long.filter("_none").isEmpty():
        only = quantiles(long.filter("_none"), ["_none", "feature"], "value", [0.0, 0.25, 0.5, 0.75, 1.0])
        q = q.unionByName(only.withColumn(cluster, F.lit(None).cast(df.schema[cluster].dataType)))
    held = n.alias("n").join(q.alias("q"), F.col(f"n.{cluster}").eqNullSafe(F.col(f"q.{cluster}")) & (F.col("n.feature") == F.col("q.feature")))
    return held.select(F.col(f"n.{cluster}").alias(cluster), F.col("n.feature").alias("feature"), "n.n", *[F.col("q.q")[i].alias(c) for i, c in enumerate(("min", "q25", "median", "q75", "max"))])


def annotate(df: DataFrame, names: dict, cluster: str = "cluster", to: str = "cluster_phenotype") -> DataFrame:
    """Adds each cluster's phenotype, an empty string where there is none."""
    if not names:
        return df.withColumn(to, F.lit(""))
    table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (str(k), v)])
    return df.withColumn(to, F.coalesce(F.element_at(table, F.col(cluster).cast("string")), F.lit("")))


def cluster_members(df: DataFrame, key: Sequence[str], cluster: str = "cluster", limit: int = 10) -> DataFrame:
    """Size of each cluster and its first cells by key.

    Only ``limit`` keys of a cluster are kept while counting, so no cluster is sorted whole.
    """
    sizes = df.groupBy(cluster).agg(F.count("*").alias("size"))
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(*key))
    first = df.select(cluster, *key).withColumn("place", place).filter(F.col("place") <= limit)
    return first.join(sizes, cluster)


def auroc(u: Column, n_a: Column, n_b: Column) -> Column:
    return u / (n_a * n_b)
