"""Imputation, scaling and intensity ranges, of cells and of pixels.

Cell tables are wide; their whole-column statistics are one row, which is
broadcast. Pixel tables are long (``acq_id, y, x, channel, value``); their
statistics are a row for each image channel and are joined by key. Exact
quantiles come from a range sort of the distinct values, so that no task holds a
column; ``exact=False`` takes approximate ones in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import saved
from ..functions.prefix import quantiles
from ..functions.scalar import finite
from .products import pair_products

IMAGE = ["acq_id", "channel"]


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def melted(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep, feature, value``: a row for each row and feature."""
    wide = df.select(*keep, *[_col(f).cast("double").alias(f) for f in features])
    return wide.unpivot(list(keep), list(features), "feature", "value")


def _medians(df: DataFrame, cols: Sequence[str], prefix: str, exact: bool) -> DataFrame:
    """One row with the median of each of some columns, ``{prefix}0`` and so on; null for an empty one."""
    if not exact:
        return df.agg(*[F.percentile_approx(_col(c), 0.5).alias(f"{prefix}{i}") for i, c in enumerate(cols)])
    found = quantiles(melted(df, cols, []), ["feature"], "value", [0.5])
    return found.agg(*[F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(f"{prefix}{i}") for i, c in enumerate(cols)])


def impute_median(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """NaN, infinities and nulls become the column's median over the finite values."""
    clean = df.select("*", *[finite(_col(c).cast("double")).alias(f"_f{i}") for i, c in enumerate(cols)])
    filled = clean.crossJoin(F.broadcast(_medians(clean, [f"_f{i}" for i in range(len(cols))], "_m", exact)))
    return filled.select(*[F.coalesce(f"_f{cols.index(c)}", f"_m{cols.index(c)}").alias(c) if c in cols else _col(c) for c in df.columns])


def drop_nonfinite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with any missing value dropped; if that leaves under two rows, columns
    with missing values instead. At least 2 x 2 must remain."""
    clean = df.withColumns({c: finite(_col(c).cast("double")) for c in cols})
    bad = clean.agg(F.count_if(~_any_null(cols)).alias("rows"), F.count("*").alias("all"), *[F.count_if(_col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    if bad["rows"] >= 2 and len(cols) >= 2:
        return clean.dropna("any", subset=list(cols))
    kept = [c for i, c in enumerate(cols) if not bad[f"n{i}"]]
    if len(kept) < 2 or bad["all"] < 2:
        raise ValueError("fewer than 2 x 2 finite values remain")
    return clean.drop(*[c for c in cols if c not in kept])


def _any_null(cols: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | _col(c).isNull()
    return out


def scale_zscore(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    stats = df.agg(*[F.avg(_col(c)).alias(f"_a{i}") for i, c in enumerate(cols)], *[F.stddev_pop(_col(c)).alias(f"_s{i}") for i, c in enumerate(cols)])
    return _scaled(df, cols, stats)


def scale_mad(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """(x - median) / median absolute deviation, unscaled; zero deviation gives 0."""
    centre = _medians(df, cols, "_a", exact)
    apart = df.crossJoin(F.broadcast(centre)).select(*[F.abs(_col(c) - F.col(f"_a{i}")).alias(f"_d{i}") for i, c in enumerate(cols)])
    return _scaled(df, cols, centre.crossJoin(_medians(apart, [f"_d{i}" for i in range(len(cols))], "_s", exact)))


def _scaled(df: DataFrame, cols: Sequence[str], stats: DataFrame) -> DataFrame:
    both = df.crossJoin(F.broadcast(stats))

    def one(c: str) -> Column:
        i = list(cols).index(c)
        return F.when(F.col(f"_s{i}") > 0, (_col(c) - F.col(f"_a{i}")) / F.col(f"_s{i}")).otherwise(F.lit(0.0)).alias(c)

    return both.select(*[one(c) if c in cols else _col(c) for c in df.columns])


def _with_image_stats(pixels: DataFrame, *stats: Column, by: Sequence[str] = IMAGE) -> DataFrame:
    return pixels.join(pixels.groupBy(*by).agg(*stats), list(by))


def percentile_clip(pixels: DataFrame, lo: float = 1.0, hi: float = 99.0, flat: str = "zero", exact: bool = True) -> DataFrame:
    """Values clipped to two percentiles of their image channel and rescaled to 0-1.

    ``flat``: where both are equal, ``zero`` gives 0; ``widen`` takes hi = lo + 1e-6.
    """
    shares = [lo / 100, hi / 100]
    ends = quantiles(pixels, IMAGE, "value", shares, "_q") if exact else pixels.groupBy(*IMAGE).agg(F.percentile_approx("value", shares).alias("_q"))
    held = pixels.join(ends, IMAGE)
    a, b = F.col("_q")[0], F.col("_q")[1]
    b = F.when(b <= a, a + 1e-6).otherwise(b) if flat == "widen" else b
    scaled = (F.least(F.greatest("value", a), b) - a) / (b - a)
    return held.withColumn("value", scaled if flat == "widen" else F.when(b > a, scaled).otherwise(0.0)).drop("_q")


def robust_scale(pixels: DataFrame, lo: float = 1.0, hi: float = 99.0) -> DataFrame:
    return percentile_clip(pixels, lo, hi, flat="widen")


def minmax(pixels: DataFrame) -> DataFrame:
    """Values rescaled to 0-1 in each image channel; a flat one becomes 0."""
    held = _with_image_stats(pixels, F.min("value").alias("_a"), F.max("value").alias("_b"))
    return held.withColumn("value", F.when(F.col("_b") > F.col("_a"), (F.col("value") - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(0.0)).drop("_a", "_b")


def combine_channels(pixels: DataFrame, method: str = "mean", weights: dict[str, float] | None = None) -> DataFrame:
    """One image from several channels: ``single, mean, max, sum, weighted, minmax_mean, pca1``.

    Weights are divided by their sum plus 1e-8; channels without one get none.
    ``pca1``: first principal component of the channels over all pixels of an
    acquisition, rescaled to 0-1, its sign such that the largest loading is positive.
    """
    place = ["acq_id", "y", "x"]
    if method in ("single", "mean", "max", "sum"):
        how = {"single": F.max, "mean": F.avg, "max": F.max, "sum": F.sum}[method]
        return pixels.groupBy(*place).agg(how("value").alias("value"))
    if method == "minmax_mean":
        return combine_channels(minmax(pixels), "mean")
    if method == "weighted":
        total = sum((weights or {}).values()) + 1e-8
        table = F.create_map(*[x for k, v in (weights or {}).items() for x in (F.lit(k), F.lit(v / total))])
        return pixels.groupBy(*place).agg(F.sum(F.col("value") * F.coalesce(F.element_at(table, F.col("channel")), F.lit(0.0))).alias("value"))
    if method == "pca1":
        return _first_component(pixels)
    raise ValueError(f"unknown method {method!r}")


def _first_component(pixels: DataFrame) -> DataFrame:
    """Power iteration is not needed: the channel covariances of an image are few and go to numpy."""
    import numpy as np
    import pandas as pd

    number = F.row_number().over(Window.partitionBy("acq_id").orderBy("channel")) - 1  # a row for each channel
    means = saved(pixels.groupBy("acq_id", "channel").agg(F.avg("value").alias("m")).withColumn("i", number))
    centred = pixels.join(means, ["acq_id", "channel"]).select("acq_id", "y", "x", "channel", "i", (F.col("value") - F.col("m")).alias("v"))
    covariance = pair_products(centred.filter("v is not null"), "acq_id", ["y", "x"], "i", "v").select("acq_id", "a", "b", (F.col("s") / F.col("n")).alias("c"))

    def loadings(part: pd.DataFrame) -> pd.DataFrame:
        at, matrix = np.unique(part[["a", "b"]]), np.zeros((int(part["b"].max()) + 1,) * 2)
        matrix[part["b"], part["a"]] = part["c"]  # the lower half is read
        vector = np.linalg.eigh(matrix[np.ix_(at, at)])[1][:, -1]
        return pd.DataFrame({"acq_id": part["acq_id"].iloc[0], "i": at, "w": vector * np.sign(vector[np.abs(vector).argmax()])})

    shape = f"acq_id {pixels.schema['acq_id'].dataType.simpleString()}, i int, w double"
    scores = centred.join(covariance.groupBy("acq_id").applyInPandas(loadings, shape), ["acq_id", "i"]).groupBy("acq_id", "y", "x").agg(F.sum(F.col("v") * F.col("w")).alias("value"))
    return minmax(scores.withColumn("channel", F.lit("pca1"))).drop("channel")


def auto_range(pixels: DataFrame, linked: bool = False, contrast: bool = False) -> DataFrame:
    """``acq_id, channel, lo, hi``: display range, by extremes or the percentiles 1 and 99.

    ``linked``: one range for each channel over all images (``acq_id`` is null).
    """
    by = ["channel"] if linked else IMAGE
    if contrast:
        held = quantiles(pixels, by, "value", [0.01, 0.99]).select(*by, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    else:
        held = pixels.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    image = F.lit(None).cast(pixels.schema["acq_id"].dataType) if linked else F.col("acq_id")
    return held.select(image.alias("acq_id"), "channel", "lo", "hi")
