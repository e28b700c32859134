"""Batch correction: checks, ComBat, Harmony, batch-balanced neighbour smoothing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import BATCH_KEYS
from ..functions.joins import large
from ..functions.lineage import saved
from .neighbours import feature_join


def detect_batch(df: DataFrame) -> str | None:
    """The first usual batch column with at least two values."""
    for c in BATCH_KEYS:
        if c in df.columns and df.select(c).filter(F.col(c).isNotNull()).distinct().limit(2).count() == 2:
            return c
    return None


def validate_batch(df: DataFrame, batch: str, features: Sequence[str]) -> None:
    """Columns exist, two batches at least, none missing; else an error."""
    missing = [c for c in [batch, *features] if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    r = df.agg(F.count_distinct(batch).alias("n"), F.count_if(F.col(batch).isNull()).alias("nulls")).first()
    if r.n < 2 or r.nulls:
        raise ValueError(f"{r.n} batches and {r.nulls} rows without one: at least two and none are needed")


def usable_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features whose variance is at least 1e-10 and of which at most 95 % are zero."""
    r = df.agg(*[x for i, f in enumerate(features) for x in (F.var_pop(f"`{f}`").alias(f"v{i}"), F.avg((F.col(f"`{f}`") == 0).cast("double")).alias(f"z{i}"))]).first()
    return [f for i, f in enumerate(features) if r[f"v{i}"] is not None and r[f"v{i}"] >= 1e-10 and r[f"z{i}"] <= 0.95]


def combat(df: DataFrame, batch: str, features: Sequence[str], covariates: Sequence[str] = (), rounds: int = 200, tolerance: float = 1e-4) -> DataFrame:
    """Empirical-Bayes location and scale (Johnson, Li, Rabinovic 2007).

    Two passes over the cells, besides the checks, add up sums of each batch in Arrow
    batches: for the normal equations of batches and covariates, and of residuals; all
    else runs on the (batch x feature) table on the driver. Covariates are numbers. Unusable features stay as they are; so do
    values whose result is not a number.
    """
    validate_batch(df, batch, features)
    used = usable_features(df, features)
    if not used:
        return df
    rows = df.select(F.col(f"`{batch}`").alias("b"), *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate([*used, *covariates])])
    nf, nc = len(used), len(covariates)
    sums = _batch_sums(rows, nf, nc, None, None)
    batches = sorted(sums)
    nb = len(batches)
    n = np.array([sums[b]["n"][0] for b in batches])
    xtx, xty = np.zeros((nb + nc, nb + nc)), np.zeros((nb + nc, nf))
    for k, b in enumerate(batches):
        r = sums[b]
        xtx[k, k], xty[k] = r["n"][0], r["y"]
        xtx[k, nb:] = xtx[nb:, k] = r["x"]
        xtx[nb:, nb:] += r["xx"].reshape(nc, nc)
        xty[nb:] += r["xy"].reshape(nc, nf)
    beta = np.linalg.lstsq(xtx, xty, rcond=None)[0]
    alpha, effect = n @ beta[:nb] / n.sum(), beta[nb:]
    # About the grand mean, of which the residuals about a batch's own mean follow.
    apart = _batch_sums(rows, nf, nc, alpha, effect)
    e, e2, ny = (np.array([apart[b][c] for b in batches]) for c in ("y", "yy", "ny"))
    off = alpha - beta[:nb]
    with np.errstate(invalid="ignore", divide="ignore"):
        sigma = np.sqrt(np.maximum((e2 + 2 * off * e + ny * off * off).sum(0) / ny.sum(0), 0))
    sigma[~(sigma > 0)] = 1.0
    s, q = e / sigma, e2 / sigma**2
    number = F.array_position(F.array(*[F.lit(b) for b in batches]), F.col(batch)).cast("int") - 1
    held = df.withColumn("_b", number).withColumn("_y", F.array(*[F.col(f"`{f}`").cast("double") for f in used])).withColumn("_x", F.array(*[F.col(f"`{c}`").cast("double") for c in covariates]).cast("array<double>"))
    y, x = (lambda i: F.col("_y")[i]), (lambda i: F.col("_x")[i])
    fitted = lambda i, own: F.lit(float(own)) + sum((x(j) * float(effect[j, i]) for j in range(nc)), F.lit(0.0))
    z = lambda i: (y(i) - fitted(i, alpha[i])) / float(sigma[i])
    shift, scale = np.zeros((nb, nf)), np.ones((nb, nf))
    for b in range(nb):
        shift[b], scale[b] = shrunk(n[b], s[b], q[b], rounds, tolerance)
    table = lambda m, i: F.array(*[F.lit(float(v)) for v in m[:, i]])[F.col("_b")]
    new = {f: (z(i) - table(shift, i)) / F.sqrt(table(scale, i)) * float(sigma[i]) + fitted(i, alpha[i]) for i, f in enumerate(used)}
    return held.withColumns({f: F.when(F.isnan(v) | v.isNull(), F.col(f"`{f}`")).otherwise(v) for f, v in new.items()}).select(*df.columns)


def _batch_sums(rows: DataFrame, nf: int, nc: int, alpha: np.ndarray | None, effect: np.ndarray | None) -> dict[object, dict[str, np.ndarray]]:
    """By batch: ``n`` rows, sums ``y, yy`` of the features and of squares, ``ny`` (values there are), ``x, xx, xy``.

    rows: ``b, c0, c1, ...``, features first, then covariates. With ``alpha`` and
    ``effect``, features less these. Missing values count in no sum.
    """
    names = ("n", "y", "yy", "ny", "x", "xx", "xy")

    def add(batches):
        held: dict[object, dict[str, np.ndarray]] = {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            own = codes.indices.to_numpy()
            values = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(nf + nc)], axis=1).astype(float)
            y, x = values[:, :nf], values[:, nf:]
            if alpha is not None:
                y = y - alpha - x @ effect
            ok = ~np.isnan(y)
            y, x0 = np.where(ok, y, 0.0), np.where(np.isnan(x), 0.0, x)
            for k in np.unique(own).tolist():
                at = own == k
                found = {"n": np.array([at.sum()], float), "y": y[at].sum(0), "yy": (y[at] ** 2).sum(0), "ny": ok[at].sum(0).astype(float), "x": x0[at].sum(0), "xx": (x0[at].T @ x0[at]).ravel(), "xy": (x0[at].T @ y[at]).ravel()}
                before = held.setdefault(codes.dictionary[k].as_py(), {c: np.zeros_like(v) for c, v in found.items()})
                for c, v in found.items():
                    before[c] += v
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), rows_type), *[pa.array([v[c].tobytes() for v in held.values()], pa.binary()) for c in names]], names=["b", *names])

    rows_type = to_arrow_schema(rows.select("b").schema).field("b").type
    shape = T.StructType([rows.schema["b"], *[T.StructField(c, T.BinaryType()) for c in names]])
    out: dict[object, dict[str, np.ndarray]] = {}
    for r in rows.mapInArrow(add, shape).collect():  # a row for each batch and task, of fixed size
        own = out.setdefault(r.b, {c: np.zeros(len(r[c]) // 8) for c in names})
        for c in names:
            own[c] = own[c] + np.frombuffer(r[c])
    return out


def shrunk(n: float, s: np.ndarray, q: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Shrunken mean and variance of one batch's features, from counts, sums and squares."""
    g = s / n
    d = np.maximum(q / n - g * g, 1e-12) * n / max(n - 1, 1)
    if len(g) < 2:
        return g, d
    gbar, tau, m, v = g.mean(), g.var(ddof=1), d.mean(), d.var(ddof=1)
    if v <= 0 or tau <= 0:
        return g, d
    a, b = (2 * v + m * m) / v, (m * v + m**3) / v
    now_g, now_d = g.copy(), d.copy()
    for _ in range(rounds):
        new_g = (n * tau * g + now_d * gbar) / (n * tau + now_d)
        new_d = (b + (q - 2 * new_g * s + n * new_g * new_g) / 2) / (n / 2 + a - 1)
        change = max(np.abs(new_g - now_g).max() / max(np.abs(now_g).max(), 1e-12), np.abs(new_d - now_d).max() / max(np.abs(now_d).max(), 1e-12))
        now_g, now_d = new_g, new_d
        if change < tolerance:
            break
    return now_g, now_d


def principal_axes(df: DataFrame, features: Sequence[str], share: float | None = 0.9, k: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, axes as columns, variances): the fewest that reach the share, or k.

    Covariances are sums of block products; signs: largest loading positive.
    """
    n = len(features)
    r = df.agg(*[F.avg(F.col(f"`{f}`").cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    means = np.array([r[f"m{i}"] for i in range(n)])
    cov = _covariances(df, features, means)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(n)])
    if k is None:
        k = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share - 1e-12) + 1)
    k = max(1, min(k, n))
    return means, vectors[:, :k], values[:k]


def _covariances(df: DataFrame, features: Sequence[str], means: np.ndarray) -> np.ndarray:
    """Sample covariances; each pair of features over the rows where neither is null."""
    n = len(features)

    def add(batches):
        sums = np.zeros((3, n, n))
        for batch in batches:
            x, there = _numbers(batch.column(0), n)
            x, there = np.where(there, x - means, 0.0), there.astype(float)
            sums += np.stack([there.T @ there, x.T @ there, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    rows = _rows(df, features).mapInArrow(add, "sums binary").toLocalIterator()  # a row for each task, of fixed size
    count, own, both = sum((np.frombuffer(r.sums).reshape(3, n, n) for r in rows), np.zeros((3, n, n)))
    with np.errstate(invalid="ignore", divide="ignore"):
        return (both - own * own.T / count) / (count - 1)


def _rows(df: DataFrame, features: Sequence[str], *others: str) -> DataFrame:
    return df.select(F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("_row"), *others)


def _numbers(lists: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of ``n`` columns, and where it is not null."""
    flat = lists.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, n), flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, n)


def project(df: DataFrame, features: Sequence[str], means: np.ndarray, axes: np.ndarray, to: str) -> DataFrame:
    """Adds the principal coordinates as an array column; those of a row with a null are null."""
    (n, k), columns = axes.shape, list(df.columns)

    def put(batches):
        for batch in batches:
            x, there = _numbers(batch.column(0), n)
            z = pa.array(((x - means) @ axes).ravel(), pa.float64(), mask=np.repeat(~there.all(1), k))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(z) + 1, k, dtype=np.int32)), z)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], names=[*columns, to])

    return _rows(df, features, "*").mapInArrow(put, T.StructType([*df.schema.fields, T.StructField(to, T.ArrayType(T.DoubleType()))]))


def unproject(df: DataFrame, features: Sequence[str], means: np.ndarray, axes: np.ndarray, old: str, new: str) -> DataFrame:
    """Features moved by what their principal coordinates moved; what no axis holds stays."""
    (n, k), columns = axes.shape, list(df.columns)
    place = {c: i for i, c in enumerate(features)}

    def put(batches):
        for batch in batches:
            x, there = _numbers(batch.column(0), n)
            (before, a), (after, b) = (_numbers(batch.column(c), k) for c in (old, new))
            moved, lost = x + (after - before) @ axes.T, ~(a & b).all(1)
            own = [pa.array(moved[:, place[c]], pa.float64(), mask=~there[:, place[c]] | lost) if c in place else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(own, names=columns)

    shape = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in place else f for f in df.schema.fields])
    return _rows(df, features, "*").mapInArrow(put, shape)


def harmony(df: DataFrame, batch: str, features: Sequence[str], n_clusters: int = 30, sigma: float = 0.1, theta: float = 2.0, ridge: float = 1.0, max_iter: int = 10, share: float = 0.9, seed: int = 0, tolerance: float = 1e-4) -> DataFrame:
    """Soft clusters of mixed batches and a shift of each batch in each (Korsunsky 2019).

    A round is one pass: rows get their soft memberships in Arrow batches and
    only sums per (cluster, batch) leave the executors. The driver holds those
    sums and the centroids, whose size does not depend on the rows.
    """
    validate_batch(df, batch, features)
    means, axes, _ = principal_axes(df, features, share)
    names = sorted(r[0] for r in df.select(batch).distinct().collect())
    number = F.array_position(F.array(*[F.lit(b) for b in names]), F.col(batch)).cast("int") - 1
    held = saved(project(df, features, means, axes, "_z").withColumn("_b", number))
    d, nb = axes.shape[1], len(names)
    first = held.orderBy(F.xxhash64(F.lit(seed), *features)).limit(n_clusters).select("_z").collect()
    centres = _unit(np.array([r["_z"] for r in first], float))
    k = len(centres)
    counts = {r["_b"]: r["count"] for r in held.groupBy("_b").count().collect()}
    per = np.array([counts[b] for b in range(nb)], float)
    penalty = np.ones((k, nb))
    shift = np.zeros((k, nb, d))
    last = None
    for _ in range(max_iter):
        r = _memberships_sums(held, centres, penalty, shift, sigma, d)
        observed, sums, unit = np.zeros((k, nb)), np.zeros((k, nb, d)), np.zeros((k, d))
        for row in r:
            observed[row.k, row.b] = row.w
            sums[row.k, row.b] = row.zs
            unit[row.k] += row.us
        centres = _unit(unit)
        expected = observed.sum(1, keepdims=True) * per / per.sum()
        penalty = ((expected + 1) / (observed + 1)) ** theta
        for i in range(k):  # ridge on batch columns, none on the intercept
            design = np.zeros((nb + 1, nb + 1))
            design[0, 0], design[0, 1:], design[1:, 0] = observed[i].sum(), observed[i], observed[i]
            design[1:, 1:] = np.diag(observed[i] + ridge)
            w = np.linalg.lstsq(design, np.vstack([sums[i].sum(0), sums[i]]), rcond=None)[0]
            shift[i] = w[1:]
        if last is not None and np.abs(observed - last).sum() <= tolerance * observed.sum():
            break
        last = observed
    moved = held.mapInPandas(lambda parts: _moved(parts, centres, penalty, shift, sigma), T.StructType([*held.schema.fields, T.StructField("_n", T.ArrayType(T.DoubleType()))]))
    return unproject(moved, features, means, axes, "_z", "_n").select(*df.columns)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def _soft(z: np.ndarray, b: np.ndarray, centres: np.ndarray, penalty: np.ndarray, sigma: float) -> np.ndarray:
    distance = 2 * (1 - _unit(z) @ centres.T)
    logit = -(distance - distance.min(1, keepdims=True)) / sigma
    r = np.exp(logit) * penalty.T[b]
    return r / r.sum(1, keepdims=True)


def _memberships_sums(held: DataFrame, centres, penalty, shift, sigma: float, d: int):
    k, nb = penalty.shape

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, zs, us = np.zeros((k, nb)), np.zeros((k, nb, d)), np.zeros((k, nb, d))
        for part in parts:
            z, b = np.stack(part["_z"]), part["_b"].to_numpy()
            # Memberships follow the corrected coordinates, the ridge the original ones.
            now = z - np.einsum("nk,nkd->nd", _soft(z, b, centres, penalty, sigma), shift.transpose(1, 0, 2)[b])
            r = _soft(now, b, centres, penalty, sigma)
            for i in range(nb):
                own = b == i
                w[:, i] += r[own].sum(0)
                zs[:, i] += r[own].T @ z[own]
                us[:, i] += r[own].T @ _unit(now[own])
        yield pd.DataFrame([(i, j, w[i, j], zs[i, j].tolist(), us[i, j].tolist()) for i in range(k) for j in range(nb)], columns=["k", "b", "w", "zs", "us"])

    rows = held.select("_z", "_b").mapInPandas(run, "k int, b int, w double, zs array<double>, us array<double>")
    total = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(d)])
    return rows.groupBy("k", "b").agg(F.sum("w").alias("w"), total("zs").alias("zs"), total("us").alias("us")).collect()


def _moved(parts: Iterator[pd.DataFrame], centres, penalty, shift, sigma: float) -> Iterator[pd.DataFrame]:
    for part in parts:
        z, b = np.stack(part["_z"]), part["_b"].to_numpy()
        r = _soft(z, b, centres, penalty, sigma)
        yield part.assign(_n=list(z - np.einsum("nk,nkd->nd", r, shift.transpose(1, 0, 2)[b])))


def bbknn_smooth(df: DataFrame, key: str, batch: str, features: Sequence[str], k: int = 3, n_pcs: int = 50, probes: int | None = None) -> DataFrame:
    """Principal coordinates averaged over each cell's k nearest in every batch, and
    back; the nearest are approximate with ``probes``.

    Weights are 1/(1+d); a cell's own batch counts the cell itself among its k.
    """
    validate_batch(df, batch, features)
    means, axes, _ = principal_axes(df, features, None, n_pcs)
    held = saved(project(df, features, means, axes, "_z"))
    d = axes.shape[1]
    wide = held.select(key, batch, *[F.col("_z")[i].alias(f"p{i}") for i in range(d)])
    names = sorted(r[0] for r in df.select(batch).distinct().collect())
    found = None
    cols = [f"p{i}" for i in range(d)]
    for name in names:  # a batch is a handful
        near = feature_join(wide, wide.filter(F.col(batch) == name), key, cols, k, probes=probes, itself=True).drop("distance")
        found = near if found is None else found.unionByName(near)
    target = held.select(F.col(key).alias("other"), F.col("_z").alias("_o"))
    mean = [(F.sum(F.col("weight") * F.col("_o")[i]) / F.sum("weight")) for i in range(d)]
    smooth = found.join(large(target), "other").groupBy(key).agg(F.array(*mean).alias("_n"))
    return unproject(held.join(large(smooth), key), features, means, axes, "_z", "_n").select(*df.columns)
