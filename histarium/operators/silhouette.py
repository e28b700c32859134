"""How well clusters are apart: silhouettes by distance, squares within clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import discard, saved
from ..functions.scalar import finite


def _labelled(df: DataFrame, cols: Sequence[str], label: str, noise: Sequence) -> DataFrame:
    """``_v, _label`` of the rows that have a label, not one of ``noise``, and every value."""
    row = F.array(*[finite(F.col(f"`{c}`").cast("double")) for c in cols])
    held = df.select(row.alias("_v"), F.col(label).alias("_label")).filter(F.col("_label").isNotNull() & ~F.exists("_v", lambda x: x.isNull()))
    return held.filter(~F.col("_label").isin(list(noise))) if noise else held


def within_squares(df: DataFrame, cols: Sequence[str], label: str = "cluster", noise: Sequence = (0,)) -> DataFrame:
    """``label, n, wcss``: squared distances of each cluster's rows to their mean, in one aggregation."""
    found = _labelled(df, cols, label, noise).groupBy("_label").agg(Summarizer.metrics("count", "variance").summary(array_to_vector("_v")).alias("s"))
    total = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda a, x: a + x)
    return found.select(F.col("_label").alias(label), F.col("s.count").alias("n"), (total * (F.col("s.count") - 1)).alias("wcss"))


def _first_hashes(held: DataFrame, sample: int) -> list:
    """The ``sample`` rows of the smallest hashes, in their order.

    Sorting would send so many rows of each task to the driver. Hashes are even, so
    rows below the share that is wanted are asked for, with a margin of eight deviations;
    were they too few, the share is doubled.
    """
    n, wide = held.count(), sample + 8 * sample**0.5 + 64
    while True:
        share = wide / n if n else 1.0
        low = held if share >= 1 else held.filter(F.col("_h.h") <= int(-(2**63) + share * 2**64))
        rows = low.collect()
        if share >= 1 or len(rows) >= sample:
            return sorted(rows, key=lambda r: tuple(r["_h"]))[:sample]
        wide *= 2


def silhouette(df: DataFrame, cols: Sequence[str], label: str = "cluster", sample: int = 10_000, noise: Sequence = (0,), seed: int = 0) -> DataFrame:
    """``label, n, silhouette``: mean euclidean silhouette of each cluster, and of all rows (label null).

    Every labelled row is scored. Its mean distances to clusters are taken over
    ``sample`` rows chosen by a hash, all rows if they are no more: then the result is
    exact. The sample goes to every task (``sample`` x columns x 8 bytes), and rows meet
    it in blocks. A row alone in its cluster, by the sample, has 0, as all have with one
    cluster; a cluster without a row in the sample is nobody's nearest.
    """
    held = _labelled(df, cols, label, noise).withColumn("_id", F.monotonically_increasing_id())
    held = saved(held.withColumn("_h", F.struct(F.xxhash64(F.lit(seed), "_id").alias("h"), "_id")).drop("_id"))
    chosen = _first_hashes(held, sample)
    names = sorted({r["_label"] for r in chosen})
    points = np.array([r["_v"] for r in chosen], float).reshape(len(chosen), len(cols))
    one = np.zeros((len(chosen), len(names)))
    one[np.arange(len(chosen)), [names.index(r["_label"]) for r in chosen]] = 1
    middle, count = points.mean(0) if len(chosen) else np.zeros(len(cols)), one.sum(0)
    points = points - middle
    squares = (points**2).sum(1)
    place = {c: i for i, c in enumerate(names)}
    last = chosen[-1]["_h"] if chosen else None

    def score(batches):
        for batch in batches:
            labels = batch.column("_label").to_pylist()
            own = np.array([place.get(c, -1) for c in labels], int)
            inside = batch.column("_in").to_numpy(zero_copy_only=False).astype(bool)
            x = batch.column("_v").flatten().to_numpy().reshape(len(own), -1) - middle
            s = np.zeros(len(own))
            for lo in range(0, len(own), 256):
                part, mine, known = x[lo : lo + 256], own[lo : lo + 256], inside[lo : lo + 256]
                size = (part**2).sum(1)[:, None] + squares
                d = size - 2 * part @ points.T
                i, j = np.nonzero(d < 1e-6 * size)  # near points lose digits in the difference
                d[i, j] = ((part[i] - points[j]) ** 2).sum(1)
                sums, at = np.sqrt(np.maximum(d, 0)) @ one, np.arange(len(mine))
                others = count[mine] - known
                a = sums[at, mine] / np.maximum(others, 1)
                mean = np.divide(sums, count, out=np.full(sums.shape, np.inf), where=count > 0)
                mean[at[mine >= 0], mine[mine >= 0]] = np.inf
                b = mean.min(1)
                wide = np.maximum(a, b)
                good = (mine >= 0) & (others > 0) & np.isfinite(b) & (wide > 0)
                s[lo : lo + 256][good] = ((b - a)[good]) / wide[good]
            yield pa.RecordBatch.from_arrays([batch.column("_label"), pa.array(s)], names=["_label", "s"])

    if last is None:
        scored = held.select("_label", F.lit(0.0).alias("s"))
    else:
        within = F.col("_h") <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["_id"]).alias("_id"))
        scored = held.select("_label", "_v", within.alias("_in")).mapInArrow(score, f"_label {held.schema['_label'].dataType.simpleString()}, s double")
    out = saved(scored.groupingSets([["_label"], []], "_label").agg(F.count("*").alias("n"), F.avg("s").alias("silhouette")))
    discard(held)
    return out.withColumnRenamed("_label", label)
