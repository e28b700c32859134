"""Rank correlation of channels over pixels, and corrections for many tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import saved
from ..functions.prefix import counted
from ..functions.scalar import finite
from ..functions.tails import t_two_sided
from .features import in_cells
from .products import pair_products


def _channels(held: DataFrame, complete: bool) -> DataFrame:
    """``acq_id, channel, i, c``: channels numbered in an acquisition, and so the patterns of
    missing values; channels that are finite at the same pixels share one.

    A pattern is told by its number of pixels and two sums (exclusive or) of hashes of them.
    """
    at = [F.bit_xor(F.xxhash64(F.lit(seed), "y", "x")) for seed in (1, 2)]
    seen = held.select("acq_id", "channel").distinct() if complete else held.groupBy("acq_id", "channel").agg(F.count("*").alias("n"), *[x.alias(f"x{i}") for i, x in enumerate(at)])
    of, by = Window.partitionBy("acq_id"), Window.partitionBy("acq_id", "n", "x0", "x1")  # a row for each channel
    first = seen.withColumn("first", F.lit("") if complete else F.min("channel").over(by))
    return first.select("acq_id", "channel", (F.row_number().over(of.orderBy("channel")) - 1).alias("i"), (F.dense_rank().over(of.orderBy("first")) - 1).alias("c"), (F.col("channel") == F.col("first")).alias("leads"))


def _centred_ranks(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``rank``, the average rank of ``value`` in its group less the mean rank."""
    steps = counted(df, by, "value")
    sizes = steps.groupBy(*by).agg(F.max(F.col("_before") + F.col("_n")).alias("_all"))
    ranked = steps.join(sizes, list(by)).select(*by, "value", (F.col("_before") + (F.col("_n") - F.col("_all")) / 2).alias("rank"))
    return df.join(ranked, [*by, "value"])


def pixel_correlation(pixels: DataFrame, mask: DataFrame | None = None, complete: bool = False) -> DataFrame:
    """``acq_id, channel_a, channel_b, r, n, p``: Spearman's for each two channels.

    Pairs use the pixels at which both are finite; under three are left out. Values
    are ranked once for each channel and pattern of missing values that it meets
    (once for a channel without gaps), then a pixel's ranks are one vector, and pairs
    are sums of block products. ``complete``: the caller knows that there are no gaps,
    so they are not looked for. p is two-sided by Student's t; a perfect correlation has p 0.
    """
    held = pixels.select("acq_id", "y", "x", "channel", finite(F.col("value").cast("double")).alias("value")).filter("value is not null")
    held = in_cells(held, mask).drop("cell_id") if mask is not None else held
    channels = saved(_channels(held, complete))
    patterns = (channels.agg(F.max("c")).first()[0] or 0) + 1
    coded = held.join(channels.drop("leads"), ["acq_id", "channel"])
    if patterns > 1:
        there = held.join(channels.filter("leads"), ["acq_id", "channel"]).select("acq_id", "y", "x", F.col("c").alias("met"))
        coded = coded.join(there, ["acq_id", "y", "x"])
    else:
        coded = coded.withColumn("met", F.lit(0))
    coded = coded.select("acq_id", "y", "x", (F.col("i") * patterns + F.col("met")).cast("int").alias("code"), "value")
    sums = saved(pair_products(_centred_ranks(coded, ["acq_id", "code"]), "acq_id", ["y", "x"], "code", "rank"))
    own = sums.filter("a = b")
    both = sums.filter(F.expr(f"a div {patterns} < b div {patterns}"))
    for end, other in (("a", "b"), ("b", "a")):  # ranks of an end are those under the other's pattern
        named = channels.select("acq_id", F.col("channel").alias(f"channel_{end}"), F.col("i").alias(f"i{end}"), F.col("c").alias(f"c{end}"))
        both = both.withColumn(f"i{end}", F.expr(f"cast({end} div {patterns} as int)")).join(named, ["acq_id", f"i{end}"])
        both = both.join(own.select("acq_id", F.col("a").alias(end), F.col("s").alias(f"s{end}")), ["acq_id", end])
    met = F.expr(f"a % {patterns} = cb and b % {patterns} = ca")
    r = both.filter(met & (F.col("n") >= 3)).select("acq_id", "channel_a", "channel_b", F.try_divide("s", F.sqrt("sa") * F.sqrt("sb")).alias("r"), "n")
    r = r.withColumn("r", F.when(F.col("r").isNotNull() & ~F.isnan("r"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))))
    t = F.abs("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    return r.withColumn("p", F.when(F.abs("r") >= 1, 0.0).when(F.col("r").isNotNull(), t_two_sided(t, (F.col("n") - 2).cast("double"))))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + .. + 1/n, term by term up to 1,000, else by Euler's series, which is exact to the last digits there."""
    summed = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(1000)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / i)
    return F.when(n <= 1000, summed).otherwise(F.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * F.pow(n, 2)))


def adjust_p(df: DataFrame, method: str = "fdr_bh", by: Sequence[str] = (), p: str = "p", to: str = "p_adjusted") -> DataFrame:
    """Adds corrected p-values: ``bonferroni``, ``fdr_bh`` or ``fdr_by``, in each group.

    Null p-values stay null and do not count. Tests are as many as pairs of
    channels or groups, so a group is small.
    """
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    n = F.count(p).over(whole)
    if method == "bonferroni":
        return df.withColumn(to, F.least(F.col(p) * n, F.lit(1.0)))
    if method not in ("fdr_bh", "fdr_by"):
        raise ValueError(f"unknown method {method!r}")
    ranked = df.withColumn("_n", n).withColumn("_i", F.when(F.col(p).isNotNull(), F.row_number().over(whole.orderBy(F.col(p).asc_nulls_last()))))
    # The sum is found at a group's first row only, as it takes steps.
    factor = F.max(F.when(F.col("_i") == 1, harmonic(F.col("_n")))).over(whole) if method == "fdr_by" else F.lit(1.0)
    raw = ranked.withColumn("_q", F.col(p) * F.col("_n") * factor / F.col("_i"))
    least = F.min("_q").over(whole.orderBy(F.col("_i").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    return raw.withColumn(to, F.when(F.col(p).isNotNull(), F.least(least, F.lit(1.0)))).drop("_n", "_i", "_q")


def correlation_by_condition(correlations: DataFrame, condition: str = "condition") -> DataFrame:
    """Mean r and p and summed n of each pair, in each condition and over all
    (condition null), with Benjamini-Hochberg inside a condition."""
    held = correlations.groupingSets([[condition, "channel_a", "channel_b"], ["channel_a", "channel_b"]], condition, "channel_a", "channel_b").agg(
        F.grouping(condition).alias("overall"), F.avg("r").alias("r"), F.avg("p").alias("p"), F.sum("n").alias("n"), F.count("*").alias("n_rois")
    )
    return adjust_p(held, "fdr_bh", ["overall", condition])


def correlation_matrix(correlations: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Symmetric wide matrix with diagonal 1; ``correlations``: ``channel_a, channel_b, r``."""
    ends = correlations.select("channel_a", "channel_b", "r")
    same = ends.select("channel_a").union(ends.select("channel_b")).distinct().select("channel_a", F.col("channel_a").alias("channel_b"), F.lit(1.0).alias("r"))
    both = ends.unionByName(ends.select(F.col("channel_b").alias("channel_a"), F.col("channel_a").alias("channel_b"), "r")).unionByName(same)
    return both.groupBy(F.col("channel_a").alias("channel")).pivot("channel_b", list(channels)).agg(F.avg("r"))
