"""Spillover between channels: candidates, estimation, unmixing, adaptation.

A spillover matrix is a long table ``emitter, receiver, coeff`` with diagonal 1.
It has a row for each two channels of a panel, so it is collected and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import saved
from ..functions.prefix import quantiles, running_sums
from ..functions.scalar import arcsinh, isotope_mass, isotope_metal

#: Masses of the isotopes of the metals in use. Fixed values.
ISOTOPES = {
    "La": [139],
    "Ce": [140],
    "Pr": [141],
    "Nd": [142, 143, 144, 145, 146, 148, 150],
    "Sm": [147, 149, 152, 154],
    "Eu": [151, 153],
    "Gd": [152, 154, 155, 156, 157, 158, 160],
    "Tb": [159],
    "Dy": [156, 158, 160, 161, 162, 163, 164],
    "Ho": [165],
    "Er": [162, 164, 166, 167, 168, 170],
    "Tm": [169],
    "Yb": [168, 170, 171, 172, 173, 174, 176],
    "Lu": [175, 176],
    "Ir": [191, 193],
    "Pt": [195],
}


def with_isotopes(channels: DataFrame) -> DataFrame:
    """Adds ``mass`` and ``metal`` to ``channel``."""
    return channels.withColumn("mass", isotope_mass(F.col("channel"))).withColumn("metal", isotope_metal(F.col("channel")))


def spill_candidates(channels: DataFrame, isotopes: dict[str, list[int]] | None = None) -> DataFrame:
    """``emitter, receiver``: channels one mass away, an oxide (16) above, or at
    another isotope of the emitter's metal. Channels without a mass take no part."""
    table = channels.sparkSession.createDataFrame([(m, x) for m, xs in (ISOTOPES if isotopes is None else isotopes).items() for x in xs], "metal string, isotope int")
    own = with_isotopes(channels.select("channel").distinct()).filter("mass is not null")
    near = own.select(F.col("channel").alias("emitter"), F.explode(F.array(*[F.col("mass") + d for d in (-1, 1, 16)])).alias("mass"), F.col("mass").alias("own"))
    impure = own.join(F.broadcast(table), "metal").select(F.col("channel").alias("emitter"), F.col("isotope").alias("mass"), F.col("mass").alias("own"))
    wanted = near.unionByName(impure).filter("mass != own").select("emitter", "mass").distinct()
    return wanted.join(own.select("mass", F.col("channel").alias("receiver")), "mass").select("emitter", "receiver").distinct()


def align_channels(features: Sequence[str], spill: DataFrame, mapping: dict[str, str] | None = None, strict: bool = False) -> list[tuple[str, str]]:
    """(feature column, channel) for the columns that the matrix has. ``strict``: a mismatch is an error."""
    names = {r.receiver for r in spill.select("receiver").distinct().collect()}
    found = [(f, (mapping or {}).get(f, f)) for f in features]
    if strict and {c for _, c in found} != names:
        raise ValueError(f"channels do not match: {sorted({c for _, c in found} ^ names)}")
    return [(f, c) for f, c in found if c in names]


def infer_donor(acqs: DataFrame, channels: DataFrame, explicit: DataFrame) -> DataFrame:
    """``acq_id, donor``: the stained channel of each single-stain acquisition.

    acqs: ``acq_id, idx, name, well``; explicit: ``key, donor`` (index, id, name or
    well). Else the only channel whose name stands in the well or name; else the
    only one whose metal does; else null.
    """
    keyed = acqs.select("acq_id", F.posexplode(F.array(F.col("idx").cast("string"), F.col("acq_id"), F.col("name"), F.col("well"))).alias("rank", "key"))
    told = keyed.join(explicit, "key").groupBy("acq_id").agg(F.min_by("donor", "rank").alias("told"))
    where = F.lower(F.coalesce(F.nullif("well", F.lit("")), F.col("name")))
    metal = F.regexp_extract(F.lower("channel"), "^([a-z]+)", 1)
    met = acqs.select("acq_id", where.alias("where")).crossJoin(channels.select("channel").distinct())
    met = met.withColumn("whole", F.contains("where", F.lower("channel"))).withColumn("part", (metal != "") & F.contains("where", metal))
    guess = met.groupBy("acq_id").agg(F.count_if("whole").alias("n1"), F.max(F.when(F.col("whole"), F.col("channel"))).alias("c1"), F.count_if("part").alias("n2"), F.max(F.when(F.col("part"), F.col("channel"))).alias("c2"))
    donor = F.coalesce("told", F.when(F.col("n1") == 1, F.col("c1")), F.when((F.col("n1") == 0) & (F.col("n2") == 1), F.col("c2")))
    return acqs.select("acq_id").join(told, "acq_id", "left").join(guess, "acq_id", "left").select("acq_id", donor.alias("donor"))


def spill_rows(pixels: DataFrame, donors: DataFrame, cap: float = 0.3, p_low: float = 90.0, p_high: float = 99.9) -> DataFrame:
    """``acq_id, emitter, receiver, coeff, pixels``: slopes through the origin on the
    donor's foreground, the pixels between two percentiles; none below 0 or over ``cap``."""
    own = pixels.join(donors, "acq_id")
    donor = own.filter("channel = donor").select("acq_id", "y", "x", F.col("value").alias("d"))
    range_ = donor.groupBy("acq_id").agg(F.percentile("d", F.array(F.lit(p_low / 100), F.lit(p_high / 100))).alias("q"))
    front = donor.join(range_, "acq_id").filter("d >= q[0] and d <= q[1]").drop("q")
    slope = F.sum(F.col("d") * F.col("value")) / (F.sum(F.col("d") * F.col("d")) + 1e-12)
    held = own.join(front, ["acq_id", "y", "x"]).groupBy("acq_id", F.col("donor").alias("emitter"), F.col("channel").alias("receiver")).agg(slope.alias("b"), F.count("*").alias("pixels"))
    coeff = F.when(F.col("emitter") == F.col("receiver"), 1.0).otherwise(F.least(F.greatest("b", F.lit(0.0)), F.lit(cap)))
    return held.select("acq_id", "emitter", "receiver", coeff.alias("coeff"), "pixels")


def spill_matrix(rows: DataFrame, channels: DataFrame, aggregate: str = "median") -> DataFrame:
    """``emitter, receiver, coeff``: rows of a donor joined over acquisitions; identity for channels without any."""
    how = F.percentile("coeff", 0.5) if aggregate == "median" else F.avg("coeff")
    own = rows.groupBy("emitter", "receiver").agg(how.alias("c"))
    names = channels.select("channel").distinct()
    every = names.select(F.col("channel").alias("emitter")).crossJoin(names.select(F.col("channel").alias("receiver")))
    same = F.col("emitter") == F.col("receiver")
    return every.join(own, ["emitter", "receiver"], "left").select("emitter", "receiver", F.when(same, 1.0).otherwise(F.coalesce("c", F.lit(0.0))).alias("coeff"))


def spill_qc(rows: DataFrame, matrix: DataFrame) -> DataFrame:
    """``donor, n_acqs, offdiag_sum, offdiag_max, offdiag_max_recipient, pixels_used_median``."""
    off = matrix.filter("emitter != receiver").groupBy(F.col("emitter").alias("donor")).agg(F.sum("coeff").alias("offdiag_sum"), F.max("coeff").alias("offdiag_max"), F.max_by("receiver", F.struct("coeff", "receiver")).alias("r"))
    used = rows.filter("emitter = receiver").groupBy(F.col("emitter").alias("donor")).agg(F.count_distinct("acq_id").alias("n"), F.percentile("pixels", 0.5).alias("p"))
    return off.join(used, "donor", "left").select("donor", F.coalesce("n", F.lit(0)).alias("n_acqs"), "offdiag_sum", "offdiag_max", F.when(F.col("offdiag_max") > 0, F.col("r")).alias("offdiag_max_recipient"), F.coalesce("p", F.lit(0.0)).cast("long").alias("pixels_used_median"))


def _trimmed(counts: DataFrame, by: Sequence[str], trim: float, to: str) -> DataFrame:
    """Mean of the values left when a share is cut at either end, of values with their
    numbers ``n``; distinct values are ranked by a range sort."""
    distinct = counts.groupBy(*by, "value").agg(F.sum("n").alias("_n"))
    steps = running_sums(distinct, [*by, "value"], "_n", by).drop("_index")
    sizes = steps.groupBy(*by).agg(F.max(F.col("_before") + F.col("_n")).alias("_all"))
    lo, hi = F.floor(F.lit(trim) * F.col("_all")), F.ceil(F.lit(1 - trim) * F.col("_all"))
    whole = hi <= lo
    lo, hi = F.when(whole, 0).otherwise(lo), F.when(whole, F.col("_all")).otherwise(hi)
    left = F.greatest(F.least(F.col("_before") + F.col("_n"), hi) - F.greatest("_before", lo), F.lit(0))
    return steps.join(sizes, list(by)).groupBy(*by).agg((F.sum(F.col("value") * left) / F.sum(left)).alias(to))


def compute_spillmat(events: DataFrame, channels: DataFrame, method: str = "default", trim: float = 0.5, threshold: float = 1e-5, interactions: str = "default", isotopes: dict[str, list[int]] | None = None) -> DataFrame:
    """``emitter, receiver, coeff`` from events that carry the mass they are stained for.

    events: ``event_id, bc_id, channel, value`` (long; ``bc_id`` 0: unassigned).
    Negatives of a channel leave out unassigned events, the donor's and those of
    donors that the channel or the donor spills into. ``default``: median of the
    events' background-free ratios; ``classic``: ratio of trimmed means.
    """
    spark = events.sparkSession
    panel = spark.createDataFrame(channels.select("channel").distinct().collect(), "channel string")
    near = spill_candidates(panel, isotopes)
    names = with_isotopes(panel).filter("mass is not null")
    every = names.select(F.col("channel").alias("emitter")).crossJoin(names.select(F.col("channel").alias("receiver"))).filter("emitter != receiver")
    pairs = near if interactions == "default" else every
    mass = {r.channel: r.mass for r in names.collect()}  # a panel's channels
    spills: dict[str, set[str]] = {}
    for r in near.collect():
        spills.setdefault(r.emitter, set()).add(r.receiver)
    # Events are counted by barcode and value before they meet the pairs: those are many to an event.
    counts = saved(events.filter(F.col("value").isNotNull() | F.col("bc_id").isin(list(mass.values()))).groupBy("channel", "bc_id", "value").agg(F.count("*").alias("n")))
    donors = {r.bc_id for r in counts.select("bc_id").filter(F.col("bc_id").isin(list(mass.values()))).distinct().collect()} - {0}  # masses of the panel
    counts = counts.filter("value is not null")
    rows = []
    for r in pairs.collect():
        if mass[r.emitter] in donors:
            out_i = {0, mass[r.emitter], *(mass[c] for c in spills.get(r.emitter, ()))}
            rows.append((r.emitter, r.receiver, mass[r.emitter], sorted(out_i), sorted(out_i | {mass[r.receiver]} | {mass[c] for c in spills.get(r.receiver, ())})))
    plan = F.broadcast(spark.createDataFrame(rows, "emitter string, receiver string, donor int, out_i array<int>, out_j array<int>"))  # pairs of a panel
    by = ["emitter", "receiver"]
    share = 0.1 if method == "default" else trim
    neg_i = _trimmed(counts.join(plan, F.col("channel") == F.col("emitter")).filter(~F.array_contains("out_i", F.col("bc_id").cast("int"))), by, share, "bg_i")
    neg_j = _trimmed(counts.join(plan, F.col("channel") == F.col("receiver")).filter(~F.array_contains("out_j", F.col("bc_id").cast("int"))), by, share, "bg_j")
    if method == "classic":
        pos = counts.join(plan.select(*by, "donor"), F.col("bc_id") == F.col("donor"))
        pos_i, pos_j = _trimmed(pos.filter("channel = emitter"), by, trim, "m_i"), _trimmed(pos.filter("channel = receiver"), by, trim, "m_j")
        held = pos_i.join(pos_j, by).join(neg_i, by, "left").join(neg_j, by, "left").fillna(0.0, ["bg_i", "bg_j"])
        spill, receive = F.greatest(F.col("m_i") - F.col("bg_i"), F.lit(0.0)), F.greatest(F.col("m_j") - F.col("bg_j"), F.lit(0.0))
        found = held.select(*by, F.when(spill > 0, receive / spill).otherwise(0.0).alias("c"))
    else:
        # A stained event is brought together once, and makes its pairs where it is.
        stained = events.filter(F.col("bc_id").isin(sorted(donors)) & F.col("event_id").isNotNull()).groupBy("event_id", F.col("bc_id").alias("donor")).agg(F.collect_list(F.struct("channel", F.col("value").alias("v"))).alias("held"))
        value = lambda end: F.explode(F.transform(F.filter("held", lambda x: x["channel"] == F.col(end)), lambda x: x["v"]))
        met = stained.join(plan.select(*by, "donor"), "donor").select("*", value("emitter").alias("vi")).select(*by, "vi", value("receiver").alias("vj"))
        # A row for each pair of a panel: were events dealt by pair, few tasks would have them all.
        held = met.join(F.broadcast(neg_i), by, "left").join(F.broadcast(neg_j), by, "left").fillna(0.0, ["bg_i", "bg_j"])
        ratio = F.greatest(F.col("vj") - F.col("bg_j"), F.lit(0.0)) / F.greatest(F.col("vi") - F.col("bg_i"), F.lit(1e-12))
        found = quantiles(held.select(*by, ratio.alias("value")), by, "value", [0.5]).select(*by, F.col("q")[0].alias("c"))
    full = names.select(F.col("channel").alias("emitter")).crossJoin(names.select(F.col("channel").alias("receiver"))).join(found, by, "left")
    return full.select(*by, F.when(F.col("emitter") == F.col("receiver"), 1.0).when(F.col("c") >= threshold, F.col("c")).otherwise(0.0).alias("coeff"))


def matrix_of(spill: DataFrame, channels: Sequence[str]) -> np.ndarray:
    """The coefficients as a square array, in the order of ``channels``."""
    at = {c: i for i, c in enumerate(channels)}
    out = np.eye(len(channels))
    for r in spill.filter(F.col("emitter").isin(list(channels)) & F.col("receiver").isin(list(channels))).collect():
        out[at[r.emitter], at[r.receiver]] = r.coeff
    return out


def unmix(y: np.ndarray, s: np.ndarray, steps: int = 300, tolerance: float = 1e-12, orientation: str = "reference") -> np.ndarray:
    """Non-negative z with the least squares of S z - y, for each row of y, by projected gradient.

    ``orientation``: ``reference`` models a row as S z; ``usual`` as its transpose.
    Rows stop on their own, so a row's result does not depend on its batch.
    """
    s = s if orientation == "reference" else s.T
    rate = 1 / (np.linalg.svd(s, compute_uv=False)[0] ** 2 + 1e-12)
    z = np.maximum(y @ np.linalg.inv(s + 1e-6 * np.eye(len(s))).T, 0)
    live = np.arange(len(y))
    for _ in range(steps):
        now = z[live]
        new = np.maximum(now - rate * ((now @ s.T - y[live]) @ s), 0)
        z[live] = new
        live = live[np.abs(new - now).max(axis=1, initial=0) > tolerance * np.maximum(np.abs(new).max(axis=1, initial=0), 1)]
        if not len(live):
            break
    return z


def exact_unmix(y: np.ndarray, s: np.ndarray, orientation: str = "reference") -> np.ndarray:
    """The same minimum by active sets (Lawson and Hanson). Rows with the same set are solved at once."""
    s = s if orientation == "reference" else s.T
    z, on = np.zeros(y.shape), np.zeros(y.shape, bool)
    enough = 1e-10 * np.maximum(1.0, np.abs(y).max(axis=1, initial=0))

    def solved(rows: np.ndarray) -> np.ndarray:
        t = np.zeros((len(rows), len(s)))
        sets, of = np.unique(on[rows], axis=0, return_inverse=True)
        for k, own in enumerate(sets):
            some = np.flatnonzero(of.ravel() == k)
            t[np.ix_(some, own)] = y[rows[some]] @ np.linalg.pinv(s[:, own]).T
        return t

    live = np.arange(len(y))
    for _ in range(10 * len(s)):
        gain = (y[live] - z[live] @ s.T) @ s
        gain[on[live]] = -np.inf
        best = gain.argmax(axis=1)
        more = gain[np.arange(len(live)), best] > enough[live]
        live = live[more]
        if not len(live):
            break
        on[live, best[more]] = True
        inner = live
        while len(inner):
            t = solved(inner)
            good = ((t > 0) | ~on[inner]).all(axis=1)
            z[inner[good]] = t[good]
            inner, t = inner[~good], t[~good]
            now = z[inner]
            bad = on[inner] & (t <= 0)
            step = np.where(bad, now / np.maximum(now - t, 1e-300), np.inf).min(axis=1, initial=np.inf)
            now = now + step[:, None] * (t - now)
            on[inner] &= now > 1e-12
            z[inner] = np.where(on[inner], now, 0)
    return z


def compensate_sets(cells: DataFrame, spill: DataFrame, sets: Sequence[dict[str, str]], method: str = "pgd", orientation: str = "reference", steps: int = 300) -> DataFrame:
    """``cells`` with several sets of columns unmixed, each with the one matrix, in one pass over Arrow batches.

    A set: column -> channel; those of which the matrix has the channel are
    unmixed. Rows with a missing value in a set keep that set as it is.
    """
    pairs = [align_channels(list(columns), spill, columns) for columns in sets]
    solve = {"pgd": lambda y, m: unmix(y, m, steps, orientation=orientation), "nnls": lambda y, m: exact_unmix(y, m, orientation)}[method]
    work = [([f for f, _ in p], matrix_of(spill, [c for _, c in p])) for p in pairs if p]
    plain = cells.withColumns({f: F.col(f"`{f}`").cast("double") for names, _ in work for f in names})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for names, matrix in work:
                y = part[names].to_numpy(float)
                ok = np.isfinite(y).all(axis=1)
                y[ok] = solve(y[ok], matrix)
                part[names] = y
            yield part

    return plain.mapInPandas(run, plain.schema)


def compensate(cells: DataFrame, spill: DataFrame, columns: dict[str, str], method: str = "pgd", cofactor: float | None = None, orientation: str = "reference", steps: int = 300) -> DataFrame:
    """``cells`` with unmixed columns; ``columns``: column -> channel, for those the matrix has.

    Other columns are unchanged; rows with a missing value among the columns stay
    as they are; ``cofactor`` adds ``{column}_arcsinh``. Rows are unmixed in Arrow batches.
    """
    names = [f for f, _ in align_channels(list(columns), spill, columns)]
    out = compensate_sets(cells, spill, [columns], method, orientation, steps)
    return out if cofactor is None else out.withColumns({f"{f}_arcsinh": arcsinh(F.col(f"`{f}`"), cofactor) for f in names})


def compensate_pixels(pixels: DataFrame, spill: DataFrame, channels: Sequence[str], mask: DataFrame | None = None, orientation: str = "reference", steps: int = 200) -> DataFrame:
    """Unmixed pixels; with ``mask``, only those in cells. Channels must be in the matrix or stay as they are."""
    wide = pixels.groupBy("acq_id", "y", "x").pivot("channel", list(channels)).agg(F.first("value"))
    if mask is not None:
        wide = wide.join(mask.filter("cell_id > 0").select("acq_id", "y", "x"), ["acq_id", "y", "x"], "left_semi")
    return compensate(wide, spill, {c: c for c in channels}, orientation=orientation, steps=steps).unpivot(["acq_id", "y", "x"], list(channels), "channel", "value")


def check_matrix(spill: DataFrame) -> None:
    """Coefficients within 0..1 and diagonal 1, else an error."""
    bad = spill.filter((F.col("coeff") < 0) | (F.col("coeff") > 1) | ((F.col("emitter") == F.col("receiver")) & (F.abs(F.col("coeff") - 1) > 1e-9))).limit(1).count()
    if bad:
        raise ValueError("coefficients must be within 0..1 and the diagonal 1")


def adapt_spillmat(spill: DataFrame, channels: DataFrame) -> DataFrame:
    """The matrix for another panel: common channels are copied; a new channel takes
    the column of the first with its mass; channels of one mass do not spill into
    each other there; the diagonal is 1."""
    check_matrix(spill)
    old = with_isotopes(spill.select(F.col("receiver").alias("channel")).distinct())
    new = with_isotopes(channels.select("channel").distinct()).join(old.select("channel", F.lit(True).alias("known")), "channel", "left")
    source = old.filter("mass is not null").groupBy("mass").agg(F.min("channel").alias("twin"))
    columns = new.join(source, "mass", "left").select(F.col("channel").alias("receiver"), F.col("mass").alias("mass_r"), F.coalesce("known", F.lit(False)).alias("known"), F.when(F.col("known"), F.col("channel")).otherwise(F.col("twin")).alias("from"))
    rows = new.select(F.col("channel").alias("emitter"), F.col("mass").alias("mass_e"))
    every = rows.crossJoin(columns).join(spill.select("emitter", F.col("receiver").alias("from"), "coeff"), ["emitter", "from"], "left")
    twin = ~F.col("known") & F.coalesce(F.col("mass_e") == F.col("mass_r"), F.lit(False))
    return every.select("emitter", "receiver", F.when(F.col("emitter") == F.col("receiver"), 1.0).when(twin, 0.0).otherwise(F.coalesce("coeff", F.lit(0.0))).alias("coeff"))
