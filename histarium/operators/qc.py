"""Channel quality control on pixels and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import in_cells, outside_cells

IMAGE = ["acq_id", "channel"]


def otsu(pixels: DataFrame, bins: int | None = 256, by=IMAGE) -> DataFrame:
    """``acq_id, channel, threshold``: the bin centre that parts an image's values
    with the greatest variance between the classes; flat images: their value.

    A column of whole numbers (or ``bins=None``) has one bin for each value, as a
    column of doubles has ``bins`` of equal width. Histograms are counted in
    Spark, a row for each image and used bin.
    """
    by = list(by)
    ends = pixels.groupBy(*by).agg(F.min("value").alias("a"), F.max("value").alias("b"))
    held = pixels.join(ends.filter("b > a"), by)
    if bins is None or isinstance(pixels.schema["value"].dataType, T.IntegralType):
        hist = held.groupBy(*by, F.col("value").alias("bin")).agg(F.count("*").alias("n")).withColumn("centre", F.col("bin").cast("double"))
    else:
        width = (F.col("b") - F.col("a")) / bins
        number = F.least(F.floor((F.col("value") - F.col("a")) / width), F.lit(bins - 1)).cast("int")
        hist = held.select(*by, "a", width.alias("w"), number.alias("bin")).groupBy(*by, "a", "w", "bin").agg(F.count("*").alias("n"))
        hist = hist.withColumn("centre", F.col("a") + (F.col("bin") + 0.5) * F.col("w"))
    up = Window.partitionBy(*by).orderBy("bin")
    whole = Window.partitionBy(*by)
    moment = F.col("n") * F.col("centre")
    cut = hist.select(*by, "bin", "centre", F.sum("n").over(up).alias("n1"), F.sum(moment).over(up).alias("s1"), F.sum("n").over(whole).alias("all"), F.sum(moment).over(whole).alias("sum"))
    n2 = F.col("all") - F.col("n1")
    between = F.col("n1") * n2 * F.pow(F.col("s1") / F.col("n1") - (F.col("sum") - F.col("s1")) / n2, 2)
    best = cut.filter(n2 > 0).groupBy(*by).agg(F.max_by("centre", F.struct(F.round(between, 6), -F.col("bin"))).alias("t"))
    return ends.join(best, by, "left").select(*by, F.coalesce("t", "b").alias("threshold"))


def snr(signal: Column, background: Column, sd: Column, low: Column, high: Column) -> Column:
    """Signal-to-noise with a floor under the background's spread."""
    return (signal - background) / F.greatest(sd, F.abs(background) * 0.001, F.lit(1e-6), (high - low) * 0.0001)


def _overall() -> list[Column]:
    return [F.avg("value").alias("intensity_mean"), F.stddev_pop("value").alias("intensity_std"), F.percentile("value", 0.5).alias("intensity_median"), F.min("value").alias("intensity_min"), F.max("value").alias("intensity_max"), F.count("*").alias("total_pixels")]


def qc_pixel(pixels: DataFrame) -> DataFrame:
    """A row for each image channel: Otsu's split into signal and background.

    An image with one class only takes the whole image's mean and spread for both.
    """
    held = pixels.join(otsu(pixels), IMAGE)
    above = F.col("value") > F.col("threshold")
    on, off = F.when(above, F.col("value")), F.when(~above, F.col("value"))
    out = held.groupBy(*IMAGE, "threshold").agg(
        *_overall(), F.avg(on).alias("s"), F.stddev_pop(on).alias("signal_std"), F.avg(off).alias("b"), F.stddev_pop(off).alias("bs"), F.count(on).alias("foreground_pixels"),
        F.percentile("value", F.array(*[F.lit(q) for q in (0.01, 0.25, 0.75, 0.99)])).alias("q"),
    )
    out = out.withColumns({"signal_mean": F.coalesce("s", "intensity_mean"), "background_mean": F.coalesce("b", "intensity_mean"), "background_std": F.coalesce("bs", "intensity_std")})
    coverage = F.col("foreground_pixels") / F.col("total_pixels")
    plain = F.when(F.col("background_std") > 0, (F.col("signal_mean") - F.col("background_mean")) / F.col("background_std")).otherwise(0.0)
    return out.select(
        *IMAGE, "threshold", snr(F.col("signal_mean"), F.col("background_mean"), F.col("background_std"), F.col("intensity_min"), F.col("intensity_max")).alias("snr"), plain.alias("snr_plain"),
        "signal_mean", "signal_std", "background_mean", "background_std", "intensity_mean", "intensity_std", "intensity_median", "intensity_min", "intensity_max",
        coverage.alias("coverage"), (coverage * 100).alias("coverage_pct"), "total_pixels", "foreground_pixels",
        *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((1, 25, 75, 99))],
    )


def qc_cell(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """A row for each image channel with cells: mean and spread of the cells' means
    against the pixels outside cells; without those, against the whole image."""
    cells = in_cells(pixels, mask).groupBy(*IMAGE, "cell_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    signal = cells.groupBy(*IMAGE).agg(F.avg("m").alias("signal_mean"), F.stddev_pop("m").alias("signal_std"), F.percentile("m", 0.5).alias("cell_median"), F.count("*").alias("n_cells"), F.sum("n").alias("cell_pixels"))
    outside = outside_cells(pixels, mask).groupBy(*IMAGE).agg(F.avg("value").alias("b"), F.stddev_pop("value").alias("bs"))
    held = pixels.groupBy(*IMAGE).agg(*_overall()).join(signal, IMAGE).join(outside, IMAGE, "left")
    held = held.withColumns({"background_mean": F.coalesce("b", "intensity_mean"), "background_std": F.coalesce("bs", "intensity_std")})
    coverage = F.col("cell_pixels") / F.col("total_pixels")
    return held.select(
        *IMAGE, snr(F.col("signal_mean"), F.col("background_mean"), F.col("background_std"), F.col("intensity_min"), F.col("intensity_max")).alias("snr"),
        "signal_mean", "signal_std", "cell_median", "background_mean", "background_std", "intensity_mean", "intensity_std", "intensity_median", "intensity_min", "intensity_max",
        coverage.alias("coverage"), (coverage * 100).alias("coverage_pct"), (F.col("n_cells") / F.col("total_pixels")).alias("cell_density"), "n_cells",
    )


def qc_by_channel(qc: DataFrame, metrics: list[str]) -> DataFrame:
    return qc.groupBy("channel").agg(*[F.avg(m).alias(m) for m in metrics], F.count_distinct("acq_id").alias("n_rois"))


def low_variance_channels(cell_means: DataFrame, share: float = 0.2) -> DataFrame:
    """``channel, cv, suggested``: coefficient of variation of the cells' means; the
    lowest ``share`` of the channels, one at least, are suggested to leave out.

    cell_means: ``channel, mean``, a row for each cell and channel.
    """
    cv = cell_means.groupBy("channel").agg((F.stddev_pop("mean") / (F.avg("mean") + 1e-8)).alias("cv"))
    n = cv.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("n"))
    place = F.row_number().over(Window.orderBy("cv", "channel"))  # a row for each channel
    return cv.crossJoin(F.broadcast(n)).withColumn("suggested", place <= F.col("n")).drop("n")


def qc_points(qc: DataFrame) -> DataFrame:
    """What a log-log plot of signal-to-noise against intensity can show."""
    return qc.filter("snr > 0 and intensity_mean > 0").select("acq_id", "channel", F.log10("snr").alias("log_snr"), F.log10("intensity_mean").alias("log_intensity"))


def qc_distributions(qc: DataFrame) -> DataFrame:
    """Quartiles over acquisitions for each channel; nothing positive gives 0."""

    def quartiles(value: Column) -> Column:
        return F.coalesce(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))), F.array(*[F.lit(0.0)] * 3))

    held = qc.groupBy("channel").agg(quartiles(F.when(F.col("snr") > 0, F.col("snr"))).alias("s"), quartiles(F.when(F.col("intensity_mean") > 0, F.col("intensity_mean"))).alias("i"), quartiles(F.col("coverage")).alias("c"))
    return held.select("channel", *[F.col(k)[i].alias(f"{n}_{q}") for k, n in (("s", "snr"), ("i", "intensity"), ("c", "coverage")) for i, q in enumerate(("q25", "q50", "q75"))])
