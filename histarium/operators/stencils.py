"""Image filters on pixel tables (``acq_id, channel, y, x, value``).

Pixels are copied to all tiles whose halo holds them, and tiles are filtered as
numpy blocks; only halos are read twice. Images are dense: a place without a row
counts as 0. At the image border ``nearest`` repeats the edge pixel, ``reflect``
mirrors it, ``zero`` is 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.lineage import saved
from ..functions.prefix import runs
from .components import connected_components
from .qc import otsu
from .scaling import combine_channels, minmax

IMAGE, PLACE = ["acq_id", "channel"], ["acq_id", "channel", "y", "x"]
CROSS = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
SQUARE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def disk(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]


def with_size(pixels: DataFrame) -> DataFrame:
    """Adds height ``_h`` and width ``_w`` of the image."""
    size = pixels.groupBy("acq_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    return pixels.join(size, "acq_id")


def _shifted(image: np.ndarray, offsets: Sequence[tuple[int, int]]) -> np.ndarray:
    """The values at each offset, one image above the other; the frame as wide as the largest offset is lost."""
    r = max(max(abs(i), abs(j)) for i, j in offsets)
    h, w = image.shape[0] - 2 * r, image.shape[1] - 2 * r
    return np.stack([image[r + i : r + i + h, r + j : r + j + w] for i, j in offsets])


def _framed(image: np.ndarray, width: int) -> np.ndarray:
    """The image with a frame that no caller reads, to keep its size."""
    return np.pad(image, width, mode="edge")


def median_filter(pixels: DataFrame, footprint: Sequence[tuple[int, int]] = CROSS, border: str = "nearest") -> DataFrame:
    r = max(max(abs(i), abs(j)) for i, j in footprint)
    return by_tiles(pixels, lambda im, _: _framed(np.median(_shifted(im, footprint), axis=0), r), r, border)


def n_sd_local_median(pixels: DataFrame, n_sd: float = 5.0) -> DataFrame:
    """Values far from their local median replaced by it: farther than ``n_sd`` times
    the root of the 3 x 3 mean of squared differences (1e-8 at least)."""

    def run(image: np.ndarray, _) -> np.ndarray:
        inner = image[1:-1, 1:-1]
        middle = np.median(_shifted(image, SQUARE), axis=0)
        apart = inner - middle
        mean = _shifted(apart * apart, SQUARE).mean(axis=0)
        far = apart[1:-1, 1:-1] > n_sd * np.sqrt(np.maximum(mean, 1e-8))
        return _framed(np.where(far, middle[1:-1, 1:-1], inner[1:-1, 1:-1]), 2)

    # Mirrored by a frame, an image has the medians of one whose edge is repeated.
    return by_tiles(pixels, run, 2, "reflect")


def gaussian_blur(pixels: DataFrame, sigma: float, border: str = "nearest", truncate: float = 4.0) -> DataFrame:
    """Separable Gaussian: along one axis, then along the other."""
    if sigma <= 0:
        return pixels.select(*PLACE, "value")
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()

    def run(image: np.ndarray, _) -> np.ndarray:
        h, width = image.shape[0] - 2 * r, image.shape[1] - 2 * r
        along = sum(w[i] * image[i : i + h] for i in range(2 * r + 1))
        return _framed(sum(w[j] * along[:, j : j + width] for j in range(2 * r + 1)), r)

    return by_tiles(pixels, run, r, border, size=max(256, 2 * r))


def tiles(pixels: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Pixels with each tile they belong to (``ty, tx`` and its first ``y0, x0``); tiles
    overlap, and start ``size - overlap`` apart."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    first = lambda c: F.greatest(F.ceil((F.col(c) - size + 1) / step), F.lit(0)).cast("int")
    own = lambda c: F.explode(F.sequence(first(c), F.floor(F.col(c) / step).cast("int")))
    return pixels.withColumn("ty", own("y")).withColumn("tx", own("x")).withColumn("y0", F.col("ty") * step).withColumn("x0", F.col("tx") * step)


def _each_group(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each stretch of rows with one key, in rows sorted by it; one is held at a time."""
    key, held = None, []
    for batch in batches:
        for now, lo, hi in runs(batch, keys):
            if held and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def _gathered(tables: Iterator[pa.Table], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Small tables as batches of ``rows`` or more."""
    held, n = [], 0
    for table in tables:
        held.append(table)
        n += table.num_rows
        if n >= rows:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


def _sorted_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a key in one task, one key after the other."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def by_tiles(pixels: DataFrame, run: Callable[[np.ndarray, dict[str, float]], np.ndarray], halo: int, border: str = "reflect", size: int = 256, carry: Sequence[str] = ()) -> DataFrame:
    """A numpy filter on blocks of ``size``, each with ``halo`` pixels around it.

    Inside an image the halo holds its neighbours' pixels; beyond it, the border
    rule, or with ``none`` nothing: the block ends there. ``run`` also gets the
    block's value of each column in ``carry``. A pixel goes to the one to four
    blocks that need it; a task takes its blocks one after the other.
    """
    size = max(size, halo)
    deal = lambda c, most: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - halo) / size), F.lit(0)), F.least(F.floor((F.col(c) + halo) / size), F.floor((F.col(most) - 1) / size))))
    keys = [*IMAGE, "ty", "tx"]
    dealt = with_size(pixels).withColumn("ty", deal("y", "_h")).withColumn("tx", deal("x", "_w")).select(*keys, F.col("y").cast("int"), F.col("x").cast("int"), F.col("value").cast("double"), F.col("_h").cast("int"), F.col("_w").cast("int"), *carry)
    mode = {"reflect": "symmetric", "nearest": "edge", "zero": "constant", "none": None}[border]
    kinds = to_arrow_schema(pixels.select(*PLACE).schema)

    def block(key: tuple, part: pa.Table) -> pa.Table:
        acq, channel, ty, tx = key
        h, w = part.column("_h")[0].as_py(), part.column("_w")[0].as_py()
        a, b = max(ty * size - halo, 0), max(tx * size - halo, 0)
        c, d = min((ty + 1) * size + halo, h), min((tx + 1) * size + halo, w)
        image = np.zeros((c - a, d - b))
        image[part.column("y").to_numpy() - a, part.column("x").to_numpy() - b] = part.column("value").to_numpy()
        need = [(halo - (ty * size - a), halo - (c - min((ty + 1) * size, h))), (halo - (tx * size - b), halo - (d - min((tx + 1) * size, w)))]
        i, j = (halo, halo) if mode else (ty * size - a, tx * size - b)
        own = {k: part.column(k)[0].as_py() for k in carry}
        out = run(np.pad(image, need, mode=mode) if mode else image, own)[i : i + min((ty + 1) * size, h) - ty * size, j : j + min((tx + 1) * size, w) - tx * size]
        y, x = np.indices(out.shape)
        columns = [pa.repeat(pa.scalar(acq, kinds.field("acq_id").type), out.size), pa.repeat(pa.scalar(channel, kinds.field("channel").type), out.size)]
        columns += [pa.array((v + first).ravel()).cast(kinds.field(c).type) for v, first, c in ((y, ty * size, "y"), (x, tx * size, "x"))]
        return pa.table([*columns, pa.array(out.ravel().astype(float))], names=[*PLACE, "value"])

    shape = T.StructType([*[pixels.schema[c] for c in PLACE], T.StructField("value", T.DoubleType())])
    return _sorted_by(dealt, keys).mapInArrow(lambda batches: _gathered(block(k, t) for k, t in _each_group(batches, keys)), shape)


def _extreme(image: np.ndarray, footprint, how) -> np.ndarray:
    out = image.copy()
    h, w = image.shape
    r = max(max(abs(i), abs(j)) for i, j in footprint)
    padded = np.pad(image, r, mode="symmetric")
    for i, j in footprint:
        out = how(out, padded[r + i : r + i + h, r + j : r + j + w])
    return out


def disk_extreme(image: np.ndarray, radius: int, how: Callable) -> np.ndarray:
    """Least or greatest value over a disk around each pixel, the border mirrored.

    A disk is one chord for each row: the extreme of any stretch of pixels is that
    of two overlapping ones whose length is a power of two, so the work grows with
    the radius and not with the disk's area.
    """
    h, w = image.shape
    padded = np.pad(image, radius, mode="symmetric")
    powers = [padded]  # powers[k][:, j]: over 2^k pixels from j on
    while 2 << len(powers) - 1 <= 2 * radius + 1:
        last, step = powers[-1], 1 << len(powers) - 1
        powers.append(how(last[:, : last.shape[1] - step], last[:, step:]))
    out = None
    for half in {math.isqrt(radius * radius - i * i) for i in range(radius + 1)}:
        length = 2 * half + 1
        k = length.bit_length() - 1
        first = radius - half
        chord = how(powers[k][:, first : first + w], powers[k][:, first + length - (1 << k) :][:, :w])
        for i in range(-radius, radius + 1):
            if math.isqrt(radius * radius - i * i) == half:
                rows = chord[radius + i : radius + i + h]
                out = rows.copy() if out is None else how(out, rows)
    return out


def opening(pixels: DataFrame, radius: int) -> DataFrame:
    """Greatest of the least over a disk."""
    return by_tiles(pixels, lambda im, _: disk_extreme(disk_extreme(im, radius, np.minimum), radius, np.maximum), 2 * radius)


def closing(pixels: DataFrame, radius: int) -> DataFrame:
    return by_tiles(pixels, lambda im, _: disk_extreme(disk_extreme(im, radius, np.maximum), radius, np.minimum), 2 * radius)


def _minus(a: DataFrame, b: DataFrame, floor: float | None = None) -> DataFrame:
    d = F.col("value") - F.col("o")
    return a.join(b.withColumnRenamed("value", "o"), PLACE).select(*PLACE, (d if floor is None else F.greatest(d, F.lit(floor))).alias("value"))


def white_tophat(pixels: DataFrame, radius: int) -> DataFrame:
    return _minus(pixels, opening(pixels, radius))


def black_tophat(pixels: DataFrame, radius: int) -> DataFrame:
    return _minus(closing(pixels, radius), pixels)


def background_opening(pixels: DataFrame, radius: int) -> DataFrame:
    """Background by opening subtracted, nothing below 0."""
    return _minus(pixels, opening(pixels, radius), 0.0)


def rescale_to_max(pixels: DataFrame, original: DataFrame) -> DataFrame:
    """Values scaled so that each image channel keeps its old maximum, clipped to its old range."""
    old = original.groupBy(*IMAGE).agg(F.min("value").alias("a"), F.max("value").alias("b"))
    new = pixels.groupBy(*IMAGE).agg(F.max("value").alias("m"))
    scaled = F.when(F.col("m") > 0, F.col("value") * F.col("b") / F.col("m")).otherwise(F.col("value"))
    return pixels.join(old, IMAGE).join(new, IMAGE).select(*PLACE, F.least(F.greatest(scaled, F.least("a", F.lit(0.0))), F.col("b")).alias("value"))


STEPS = ("hot", "speckle", "background")


def denoise(pixels: DataFrame, settings: dict[str, dict], order: Sequence[str] = STEPS) -> DataFrame:
    """Hot pixels, speckle and background, by channel, in the given order; channels without settings stay.

    ``settings``: channel -> ``{"hot": {"method": "median3" | "n_sd_local_median", "n_sd"},
    "speckle": {"method": "gaussian", "sigma"}, "background": {"method": "white_tophat" |
    "black_tophat" | "opening", "radius"}}``. The background step keeps the channel's old
    maximum, as it was before the first step.
    """
    if sorted(order) != sorted(STEPS):
        raise ValueError(f"order must name each of {STEPS} once")
    plans: dict[str, list[str]] = {}
    for channel, plan in settings.items():
        plans.setdefault(repr(sorted(plan.items(), key=str)), []).append(channel)
    parts = [pixels.filter(~F.col("channel").isin(list(settings))).select(*PLACE, "value")] if settings else [pixels.select(*PLACE, "value")]
    for channels in plans.values():
        plan, own = settings[channels[0]], pixels.filter(F.col("channel").isin(channels)).select(*PLACE, "value")
        out = own
        for step in order:
            if plan.get(step):
                out = _step(out, own, step, plan[step])
        parts.append(out)
    return reduce(DataFrame.unionByName, parts)


def _step(pixels: DataFrame, original: DataFrame, step: str, how: dict) -> DataFrame:
    method = how["method"]
    if step == "hot" and method in ("median3", "n_sd_local_median"):
        return n_sd_local_median(pixels, how.get("n_sd", 5.0)) if method == "n_sd_local_median" else median_filter(pixels, CROSS)
    if step == "speckle" and method == "gaussian":
        return gaussian_blur(pixels, how.get("sigma", 0.8))
    background = {"white_tophat": white_tophat, "black_tophat": black_tophat, "opening": background_opening}
    if step == "background" and method in background:
        return rescale_to_max(background[method](pixels, how.get("radius", 15)), original)
    raise ValueError(f"unknown method {method!r} for {step}")


def gradient_magnitude(pixels: DataFrame, method: str = "sobel") -> DataFrame:
    """Edge strength, rescaled to 0-1 in each image; ``inverse``: 1 minus a rescaled image."""
    if method == "inverse":
        return minmax(pixels).withColumn("value", 1 - F.col("value")).select(*PLACE, "value")
    side = np.array({"sobel": (1, 2, 1), "scharr": (3, 10, 3)}[method])
    weights = np.array([[i * side[j + 1] for i, j in SQUARE], [j * side[i + 1] for i, j in SQUARE]]) / (2.0 * side.sum())

    def run(image: np.ndarray, _) -> np.ndarray:
        gy, gx = np.tensordot(weights, _shifted(image, SQUARE), axes=1)
        return _framed(np.sqrt((gy**2 + gx**2) / 2), 1)

    return minmax(by_tiles(pixels, run, 1, "reflect")).select(*PLACE, "value")


def tile_regions(on: np.ndarray) -> np.ndarray:
    """For each pixel of a block that is on, the place (row by row) of the first pixel
    of its connected part, else -1: rows' runs are tied where they touch."""
    h, w = on.shape
    starts = on.copy()
    starts[:, 1:] &= ~on[:, :-1]
    run = np.cumsum(starts.ravel()).reshape(h, w) - 1
    root = np.arange(int(starts.sum()))
    both = on[1:] & on[:-1]
    pairs = np.unique(np.stack([run[1:][both], run[:-1][both]], axis=1), axis=0)
    while len(pairs):
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    first = np.flatnonzero(starts.ravel())
    return np.where(on, first[root][np.where(on, run, 0)] if len(first) else -1, -1)


def label_regions(on: DataFrame, size: int = 256) -> DataFrame:
    """``acq_id, y, x, region``: connected pixels (4 neighbours), named by their first pixel.

    Parts are found in tiles; only the parts that meet across a border of tiles
    are tied as a graph.
    """
    keys = ["acq_id", "ty", "tx"]
    kinds = to_arrow_schema(on.select("acq_id", "y", "x").schema)

    def parts(key: tuple, part: pa.Table) -> pa.Table:
        y, x = (part.column(c).to_numpy() for c in ("y", "x"))
        y0, x0 = key[1] * size, key[2] * size
        image = np.zeros((size, size), bool)
        image[y - y0, x - x0] = True
        own = tile_regions(image)[y - y0, x - x0]
        places = [pa.array(v).cast(kinds.field(c).type) for v, c in ((y, "y"), (x, "x"), (own // size + y0, "y"), (own % size + x0, "x"))]
        return pa.table([part.column("acq_id"), *places], names=["acq_id", "y", "x", "ry", "rx"])

    pixel = on.select("acq_id", "y", "x")
    fields = [*pixel.schema.fields, T.StructField("ry", pixel.schema["y"].dataType), T.StructField("rx", pixel.schema["x"].dataType)]
    dealt = pixel.select("acq_id", F.expr(f"y div {size}").alias("ty"), F.expr(f"x div {size}").alias("tx"), "y", "x")
    held = saved(_sorted_by(dealt, keys).mapInArrow(lambda batches: _gathered(parts(k, t) for k, t in _each_group(batches, keys)), T.StructType(fields)))
    part = F.struct("acq_id", F.col("ry").alias("y"), F.col("rx").alias("x"))
    edges = None
    for c, other in (("y", "x"), ("x", "y")):
        last = held.filter(F.col(c) % size == size - 1).select("acq_id", (F.col(c) + 1).alias(c), other, part.alias("src"))
        first = held.filter(F.col(c) % size == 0).select("acq_id", c, other, part.alias("dst"))
        met = last.join(first, ["acq_id", "y", "x"]).select("src", "dst").distinct()
        edges = met if edges is None else edges.unionByName(met)
    found = connected_components(edges)
    return held.withColumn("node", part).join(found, "node", "left").select("acq_id", "y", "x", F.coalesce("component", "node").alias("region"))


def threshold_segment(pixels: DataFrame, channels: Sequence[str], fuse: str = "mean", threshold: str = "otsu", min_area: int = 100, max_area: int = 10_000) -> DataFrame:
    """``acq_id, y, x, cell_id``: nuclear channels fused, rescaled and cut by Otsu or the
    75th percentile; connected regions of a fitting area, numbered from 1 in each image."""
    fused = combine_channels(minmax(pixels.filter(F.col("channel").isin(list(channels)))), fuse).withColumn("channel", F.lit("fused"))
    scaled = saved(minmax(fused).select(*PLACE, "value"))
    cut = otsu(scaled).select("acq_id", "threshold") if threshold == "otsu" else scaled.groupBy("acq_id").agg(F.percentile("value", 0.75).alias("threshold"))
    regions = saved(label_regions(scaled.join(cut, "acq_id").filter("value > threshold")))
    fitting = regions.groupBy("acq_id", "region").agg(F.count("*").alias("area")).filter(F.col("area").between(min_area, max_area))
    number = F.row_number().over(Window.partitionBy("acq_id").orderBy("region"))
    return regions.join(fitting.withColumn("cell_id", number).select("acq_id", "region", "cell_id"), ["acq_id", "region"]).select("acq_id", "y", "x", "cell_id")


#: Laser passes over each spot of the published high-resolution ablation kernel. Fixed values.
PASSES = [
    7, 6, 5, 8, 7, 7, 8, 7, 6, 6, 7, 9, 8, 7, 8, 8, 7, 7, 6, 6, 7, 6, 6, 5, 5, 6, 6, 5, 5, 4, 4, 6, 4, 5, 3, 4, 5, 6, 6, 5, 4, 5, 5, 4, 3, 4, 4, 3, 6, 5,
    4, 5, 5, 4, 4, 3, 3, 4, 4, 3, 3, 2, 4, 3, 2, 2, 1, 1, 3, 2, 2, 1, 1, 3, 3, 2, 2, 2, 2, 1, 1, 1, 1, 3, 2, 1, 2, 2, 1, 1, 2, 1, 1, 4, 3, 2, 1,
]
#: Contribution of each spot, before division by their sum. Fixed values.
CONTRIBUTIONS = [
    0.02, 0.00108, 0.00108, 0.0034, 0.0196, 0.0196, 0.0034, 0.0034, 0.0196, 0.0196, 0.0034, 0.00223, 0.00223, 0.00223, 0.0034, 0.0034, 0.0034, 0.0034, 0.0034, 0.0034,
    0.0196, 0.00106, 0.0196, 0.00106, 0.0196, 0.00108, 0.00106, 0.00106, 0.00106, 0.00106, 0.00108, 0.0196, 0.00106, 0.0196, 0.00106, 0.0196, 0.0196, 0.0034, 0.0034, 0.0196,
    0.0196, 0.0034, 0.0034, 0.0196, 0.0196, 0.0034, 0.0034, 0.0196, 0.00223, 0.00223, 0.00223, 0.0034, 0.0034, 0.0034, 0.0034, 0.0034, 0.0034, 0.0196, 0.00108, 0.0196,
    0.00106, 0.0196, 0.00108, 0.00106, 0.00106, 0.00106, 0.00106, 0.00108, 0.0196, 0.00106, 0.0196, 0.00106, 0.0196, 0.0034, 0.0034, 0.0196, 0.0196, 0.0034, 0.0034, 0.0196,
    0.0196, 0.0034, 0.0034, 0.00223, 0.00223, 0.00223, 0.0034, 0.0034, 0.0034, 0.0034, 0.00108, 0.00196, 0.00108, 0.00219, 0.00219, 0.00219, 0.00219,
]
#: Spots that belong to each of the kernel's nine cells, row by row. Fixed values.
KERNEL_CELLS = [
    (3, 4, 11, 14, 15, 20), (0, 5, 6, 7, 8, 12, 16, 17, 22), (9, 10, 13, 18, 19, 24),
    (31, 36, 37, 38, 39, 48, 51, 52, 57), (33, 40, 41, 42, 43, 49, 53, 54, 59), (35, 44, 45, 46, 47, 50, 55, 56, 61),
    (68, 73, 74, 75, 83, 86), (70, 76, 77, 78, 79, 84, 87, 88, 91), (72, 80, 81, 82, 85, 89),
]


def deconvolution_kernel(peak: float, x0: float = 7.0) -> np.ndarray:
    """3 x 3 kernel: what is left of the peak after each pass (a logistic in the number
    of passes about ``x0``), times its contribution, summed by kernel cell."""
    identity = np.zeros((3, 3))
    identity[1, 1] = 1.0
    if not math.isfinite(peak) or peak <= 0:
        return identity
    p, c = np.asarray(PASSES, float), np.asarray(CONTRIBUTIONS, float)
    y = (peak - peak / (1 + np.exp(-(p - x0)))) * c / c.sum()
    k = np.array([y[list(own)].sum() for own in KERNEL_CELLS])
    return (k / k.sum()).reshape(3, 3) if k.sum() > 0 else identity


def richardson_lucy_block(image: np.ndarray, kernel: np.ndarray, iterations: int) -> np.ndarray:
    """Iterations from 0.5 with zeros beyond the border, clipped to -1..1."""
    h, w = image.shape

    def convolve(a: np.ndarray, k: np.ndarray) -> np.ndarray:
        padded = np.pad(a, 1)
        return sum(k[i, j] * padded[2 - i : 2 - i + h, 2 - j : 2 - j + w] for i in range(3) for j in range(3))

    out = np.full(image.shape, 0.5)
    for _ in range(iterations):
        out = out * convolve(image / (convolve(out, kernel) + 1e-12), kernel[::-1, ::-1])
    return np.clip(out, -1, 1)


def richardson_lucy(pixels: DataFrame, x0: float = 7.0, iterations: int = 4, output: str = "float", size: int = 256) -> DataFrame:
    """Deconvolution of each image channel with the kernel of its largest value.

    Values are rescaled to 0-1 with a floor of 1e-4 for the iterations, and back;
    a frame of 3 pixels is cut off (1 where the image is small, none under 5).
    ``output="uint16"`` scales each acquisition to 0-65535. Not finite counts as 0.
    """
    clean = pixels.withColumn("value", F.when(F.isnan("value") | (F.abs("value") == float("inf")) | F.col("value").isNull(), 0.0).otherwise(F.col("value")))
    ends = clean.groupBy(*IMAGE).agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    held = clean.join(ends, IMAGE)

    def run(image: np.ndarray, own: dict[str, float]) -> np.ndarray:
        a, b = float(own["_a"]), float(own["_b"])
        scaled = (image - a) / (b - a) if b > a else image
        out = richardson_lucy_block(np.maximum(scaled, 1e-4), deconvolution_kernel(b, x0), iterations)
        return out * (b - a) + a if b > a else out

    done = with_size(by_tiles(held, run, 2 * iterations, "none", size, ["_a", "_b"]))
    cut = F.when((F.col("_h") > 6) & (F.col("_w") > 6), 3).when((F.col("_h") > 4) & (F.col("_w") > 4), 1).otherwise(0)
    done = done.filter((F.col("y") >= cut) & (F.col("y") < F.col("_h") - cut) & (F.col("x") >= cut) & (F.col("x") < F.col("_w") - cut))
    done = done.select("acq_id", "channel", (F.col("y") - cut).alias("y"), (F.col("x") - cut).alias("x"), "value")
    if output == "float":
        return done
    both = done.join(done.groupBy("acq_id").agg(F.min("value").alias("_a"), F.max("value").alias("_b")), "acq_id")
    flat = F.when((F.col("_b") >= 0) & (F.col("_b") <= 1), F.col("_b") * 65535).when(F.col("_b") > 1, F.least("_b", F.lit(65535.0))).otherwise(0.0)
    value = F.when(F.col("_b") > F.col("_a"), (F.col("value") - F.col("_a")) / (F.col("_b") - F.col("_a")) * 65535).otherwise(flat)
    return both.select(*PLACE, F.floor(value).cast("int").alias("value"))
