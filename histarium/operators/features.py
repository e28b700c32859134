"""Cell features from pixels and masks: one row for each (acquisition, cell)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.prefix import changes
from ..functions.scalar import arcsinh

CELL = ["acq_id", "cell_id"]
#: Weight of a border pixel by the code of its border neighbours. Fixed values of the perimeter estimator.
PERIMETER = {1.0: (5, 7, 15, 17, 25, 27), math.sqrt(2): (21, 33), (1 + math.sqrt(2)) / 2: (13, 23)}
SIDES = [(0, 1), (0, -1), (1, 0), (-1, 0)]
CORNERS = [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def in_cells(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels with the cell they lie in; background pixels are left out."""
    return pixels.join(mask.filter("cell_id > 0"), ["acq_id", "y", "x"])


def outside_cells(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    return pixels.join(mask.filter("cell_id > 0"), ["acq_id", "y", "x"], "left_anti")


def morphology(mask: DataFrame, pixel_size_um: float = 1.0) -> DataFrame:
    """Shape features from the mask alone. Lengths are in pixels unless
    ``pixel_size_um`` is given. One pass: counts, means and second moments."""
    s = pixel_size_um
    moments = mask.filter("cell_id > 0").groupBy(*CELL).agg(
        F.count("*").alias("n"), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"),
        (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
        F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"),
    )
    half, root = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, 2) + F.col("xy") * F.col("xy"))
    held = moments.withColumn("l1", half + root).withColumn("l2", F.greatest(half - root, F.lit(0.0)))
    major, minor = 4 * F.sqrt("l1") * s, 4 * F.sqrt("l2") * s
    return held.select(
        *CELL, "centroid_x", "centroid_y", (F.col("n") * s * s).alias("area_um2"),
        (F.sqrt(4 * F.col("n") / math.pi) * s).alias("equivalent_diameter_um"), (F.col("n") / (F.col("w") * F.col("h"))).alias("extent"),
        (F.col("w") * F.col("h") * s * s).alias("bbox_area_um2"),
        major.alias("major_axis_len_um"), minor.alias("minor_axis_len_um"),
        F.when(F.col("l1") > 0, F.sqrt(1 - F.col("l2") / F.col("l1"))).otherwise(0.0).alias("eccentricity"),
        (major / F.greatest(minor, F.lit(1e-6))).alias("aspect_ratio"),
    )


def touches_border(mask: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """``acq_id, cell_id, touches_border``; acquisitions: ``acq_id, height, width``."""
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("width") - 1) | (F.col("y") == F.col("height") - 1)
    return mask.filter("cell_id > 0").join(acquisitions, "acq_id").groupBy(*CELL).agg(F.max(edge).alias("touches_border"))


#: Side of the squares in which borders are traced.
TILE = 256


def perimeter(mask: DataFrame) -> DataFrame:
    """``acq_id, cell_id, perimeter_um, circularity``.

    A border pixel has a side neighbour outside its cell. Its code is 1, plus 2
    for each border pixel of the cell at its sides and 10 at its corners; the
    code gives its length. Pixels go to the squares that they lie in or are at most two
    pixels from, so a cell's part in a square is told there; parts are counts, which add up.
    """
    part = [*CELL, "ty", "tx"]
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 2) / TILE), F.floor((F.col(c) + 2) / TILE)))
    dealt = mask.filter("cell_id > 0").select(*CELL, "y", "x").withColumn("ty", near("y")).withColumn("tx", near("x"))
    dealt = dealt.select(*part, (F.col("y") - F.col("ty") * TILE).cast("int").alias("y"), (F.col("x") - F.col("tx") * TILE).cast("int").alias("x"))
    n = int(mask.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [f"_{i}" for i in range(len(PERIMETER))]
    shape = T.StructType([*[mask.schema[c] for c in CELL], *[T.StructField(c, T.LongType()) for c in ("n", *kinds)]])
    schema = to_arrow_schema(shape)

    def told(held: pa.RecordBatch) -> pa.RecordBatch:
        new = changes(held, part)
        own, y, x = np.cumsum(new) - 1, held.column("y").to_numpy(), held.column("x").to_numpy()
        side = TILE + 8
        places = np.unique((own * side + y + 4) * side + x + 4)

        def among(at: np.ndarray, all_: np.ndarray) -> np.ndarray:
            return all_[np.minimum(np.searchsorted(all_, at), len(all_) - 1)] == at

        step = lambda d: d[0] * side + d[1]
        border = places[~np.logical_and.reduce([among(places + step(d), places) for d in SIDES])]
        inside = (border // side % side >= 4) & (border // side % side < TILE + 4) & (border % side >= 4) & (border % side < TILE + 4)
        mine = border[inside]
        code = np.ones(len(mine), int)
        for d, w in [*((d, 2) for d in SIDES), *((d, 10) for d in CORNERS)]:
            if len(mine):
                code += w * among(mine + step(d), border)
        size, to = int(new.sum()), mine // side // side
        counts = [np.bincount(to[np.isin(code, codes)], minlength=size) for codes in PERIMETER.values()]
        area = np.bincount(own[(y >= 0) & (y < TILE) & (x >= 0) & (x < TILE)], minlength=size)
        names = held.select(CELL).take(pa.array(np.flatnonzero(new)))
        return pa.RecordBatch.from_arrays([*[names.column(c).cast(schema.field(c).type) for c in CELL], *[pa.array(v, pa.int64()) for v in (area, *counts)]], schema=schema)

    def trace(batches):
        rest = None
        for batch in batches:
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            last = np.flatnonzero(changes(batch, part))[-1:].sum()
            rest = batch.slice(last)
            if last:
                yield told(batch.slice(0, last))
        if rest is not None and rest.num_rows:
            yield told(rest)

    # Each pixel is dealt out before anything is counted: the mask may be made by few tasks.
    parts = dealt.repartition(n, *part).sortWithinPartitions(*part).mapInArrow(trace, shape)
    cells = parts.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in ("n", *kinds)])
    length = sum((F.col(c) * F.lit(v) for c, v in zip(kinds, PERIMETER, strict=True)), F.lit(0.0))
    return cells.filter("n > 0").withColumn("perimeter_um", length).select(*CELL, "perimeter_um", (4 * math.pi * F.col("n") / F.pow(F.greatest("perimeter_um", F.lit(1e-6)), 2)).alias("circularity"))


def hull_pixels(y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
    """Pixels whose centre lies in the convex hull of the cell's pixel-edge midpoints.

    y, lo, hi: the cell's rows and the first and last column in each.
    """
    points = sorted({p for r, a, b in zip(y.tolist(), lo.tolist(), hi.tolist(), strict=True) for c in (a, b) for p in ((2 * c - 1, 2 * r), (2 * c + 1, 2 * r), (2 * c, 2 * r - 1), (2 * c, 2 * r + 1))})

    def chain(sequence):
        out: list[tuple[int, int]] = []
        for p in sequence:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    def crossings(side, row):
        """Columns at which a chain of the hull meets a row."""
        for (x0, y0), (x1, y1) in zip(side, side[1:], strict=False):
            if y0 == y1 == row:
                yield from (x0, x1)
            elif min(y0, y1) <= row <= max(y0, y1) and y0 != y1:
                yield x0 + (x1 - x0) * (row - y0) / (y1 - y0)

    hull = chain(points) + chain(points[::-1])[1:]
    n = 0
    for r in range(int(y.min()), int(y.max()) + 1):
        at = list(crossings(hull, 2 * r))
        n += math.floor(max(at) / 2 + 1e-9) - math.ceil(min(at) / 2 - 1e-9) + 1
    return n


def solidity(mask: DataFrame) -> DataFrame:
    """``acq_id, cell_id, solidity``: area over pixels in the convex hull.

    Spark reduces a cell to the ends of its rows; those of one cell make a hull in numpy.
    """
    rows = mask.filter("cell_id > 0").groupBy(*CELL, "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    ends = rows.groupBy(*CELL).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("y", "lo", "hi"))).alias("ends"))

    def hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            hull = [hull_pixels(*np.array([[r["y"], r["lo"], r["hi"]] for r in e]).T) for e in part["ends"]]
            yield part[CELL].assign(solidity=part["n"].to_numpy() / np.array(hull, float))

    kinds = ", ".join(f"{c} {mask.schema[c].dataType.simpleString()}" for c in CELL)
    return ends.mapInPandas(hulls, f"{kinds}, solidity double")


def intensity_long(labelled: DataFrame, exact: bool = True, positive: float = 0.0) -> DataFrame:
    """A row for each cell and channel with all intensity statistics.

    labelled: ``acq_id, cell_id, channel, value``. Percentiles are exact, by
    linear interpolation; ``exact=False`` approximates them for very large cells.
    """
    by = [*CELL, "channel"]
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))) if exact else F.percentile_approx("value", [0.1, 0.5, 0.9])
    # Pixels go to their cell as they are: the states that collect values are wider than the values.
    stats = labelled.select(*by, "value").repartition(*CELL).groupBy(*by).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), q.alias("q"), F.sum("value").alias("integrated"),
        F.avg((F.col("value") > positive).cast("double")).alias("frac_pos"), F.collect_list("value").alias("values"),
    )
    # The deviations of one cell and channel stay with its row: no second pass over the pixels.
    spread = stats.withColumn("d", F.sort_array(F.transform("values", lambda v: F.abs(v - F.col("q")[1]))))
    n = F.size("d")
    mad = (F.element_at("d", F.floor((n + 1) / 2).cast("int")) + F.element_at("d", F.floor((n + 2) / 2).cast("int"))) / 2
    return spread.select(*by, "mean", F.col("q")[1].alias("median"), "std", mad.alias("mad"), F.col("q")[0].alias("p10"), F.col("q")[2].alias("p90"), "integrated", "frac_pos")


def intensity_wide(long: DataFrame, channels: list[str], cofactor: float | None = None, statistics: list[str] | None = None) -> DataFrame:
    """Columns ``{channel}_{statistic}``; with ``cofactor``, arcsinh of all but ``frac_pos``."""
    names = statistics or ["mean", "median", "std", "mad", "p10", "p90", "integrated", "frac_pos"]
    if cofactor is not None:
        long = long.withColumns({s: arcsinh(F.col(s), cofactor) for s in names if s != "frac_pos"})
    wide = long.groupBy(*CELL).pivot("channel", channels).agg(*[F.first(s).alias(s) for s in names])
    return wide if len(names) > 1 else wide.select(*CELL, *[F.col(f"`{c}`").alias(f"{c}_{names[0]}") for c in channels])
