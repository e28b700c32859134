"""Exact small-sample p, permutations, hulls and missing values against plain versions."""

import itertools
import math

import numpy as np
import pytest

from histarium.operators import clustering, neighbours, qc, spatial, spillover, statistics
from histarium.operators.statistics import exact_p_value, mann_whitney


@pytest.mark.parametrize("n_a, n_b", [(2, 2), (3, 4), (5, 3), (4, 7)])
def test_exact_p_counts_all_arrangements(n_a, n_b):
    us = []
    for own in itertools.combinations(range(n_a + n_b), n_a):
        us.append(sum(sum(j < i for j in range(n_a + n_b) if j not in own) for i in own))
    for u in set(us):
        far = min(u, n_a * n_b - u)
        assert exact_p_value(u, n_a, n_b) == pytest.approx(min(1, 2 * sum(x <= far for x in us) / len(us)))


def test_small_samples_without_ties_are_exact(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.5), ("b", 4.0), ("b", 5.0), ("b", 6.0), ("b", 7.0)]
    r = mann_whitney(spark.createDataFrame(rows, "g string, v double"), ["v"], "g").first()
    assert r.u == 0 and r.p == pytest.approx(2 / 35)
    tied = mann_whitney(spark.createDataFrame([*rows, ("b", 1.0)], "g string, v double"), ["v"], "g").first()
    assert tied.p != pytest.approx(exact_p_value(tied.u, 3, 5))
    wide = [("a", float(i)) for i in range(5)] + [("b", i + 0.5) for i in range(3000)]
    assert 0 < mann_whitney(spark.createDataFrame(wide, "g string, v double"), ["v"], "g").first().p < 1e-3


def test_mann_whitney_pairs_get_no_rows_of_their_own(spark):
    rng = np.random.default_rng(11)
    groups = [f"g{i}" for i in range(12)]
    rows = [(groups[int(g)], float(v), float(w)) for g, v, w in zip(rng.integers(0, 12, 1500), rng.integers(0, 90, 1500), rng.normal(size=1500), strict=True)]
    df = spark.createDataFrame([*rows, ("lone", 1.0, 1.0), (None, 2.0, 2.0), ("g0", None, float("nan")), ("g1", 3.0, float("nan"))], "g string, v double, w double")
    # Values meet once, by range, and reach the pairs of groups as sums.
    seen = []
    real = statistics.saved
    statistics.saved = lambda x: seen.append(x) or real(x)
    try:
        got = {(r.feature, r.group_a, r.group_b): r for r in mann_whitney(df, ["v", "w"], "g").collect()}
    finally:
        statistics.saved = real
    assert len(seen) == 1 and len(got) == 2 * 66
    of = {g: [r[1] for r in [*rows, ("g1", 3.0)] if r[0] == g] for g in groups}
    for a, b in itertools.combinations(sorted(groups), 2):
        r, x, y = got["v", a, b], np.array(of[a]), np.array(of[b])
        assert (r.n_a, r.n_b, r.u) == (len(x), len(y), (x[:, None] > y).sum() + (x[:, None] == y).sum() / 2)
        c = np.unique(np.r_[x, y], return_counts=True)[1].astype(float)
        n = len(x) + len(y)
        sd = math.sqrt(len(x) * len(y) / 12 * (n + 1 - (c**3 - c).sum() / (n * (n - 1))))
        z = max(abs(r.u - len(x) * len(y) / 2) - 0.5, 0) / sd
        assert r.p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)


def test_rows_with_nan_get_no_cluster(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(i % 2 * 50 + rng.normal()), float(rng.normal())) for i in range(40)] + [(90, float("nan"), 1.0), (91, None, 1.0), (92, float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    for found in (clustering.kmeans(df, ["a", "b"], 2, 2), clustering.hierarchical(df, ["a", "b"], 2, micro=8), clustering.graph_cluster(df, "k", ["a", "b"], k=5)):
        got = {r.k: r.cluster for r in found.collect()}
        assert got[90] == got[91] == got[92] == 0 and all(got[i] > 0 for i in range(40))


def test_hull_areas(spark):
    rng = np.random.default_rng(4)
    rows = [("box", x, y) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (2.0, 1.0), (4.0, 1.5))] + [("tri", 0.0, 0.0), ("tri", 6.0, 0.0), ("tri", 0.0, 2.0), ("line", 0.0, 0.0), ("line", 1.0, 1.0), ("dot", 5.0, 5.0)]
    angle = rng.random(500) * 2 * np.pi
    rows += [("disk", float(x), float(y)) for x, y in zip(10 * np.cos(angle), 10 * np.sin(angle), strict=True)]
    got = {r.roi_id: r.area for r in spatial.hull_areas(spark.createDataFrame(rows, "roi_id string, x double, y double").repartition(5)).collect()}
    order = np.sort(angle)
    disk = 50 * np.sin(np.diff(np.r_[order, order[0] + 2 * np.pi])).sum()
    assert got["box"] == pytest.approx(12) and got["tri"] == pytest.approx(6) and got["line"] == got["dot"] == 0
    assert got["disk"] == pytest.approx(disk)


def test_scatter_is_a_permutation_of_any_length():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 256, 257, 1000, 4097):
        key = np.full(n, rng.integers(0, 1 << 63), np.uint64)
        assert sorted(spatial._scatter(np.arange(n, dtype=np.uint64), np.full(n, n, np.uint64), key).tolist()) == list(range(n))
    keys = rng.integers(0, 1 << 63, 60000).astype(np.uint64)  # places 0, 1, 2 of 60,000 permutations of four
    at = [spatial._scatter(np.full(60000, i, np.uint64), np.full(60000, 4, np.uint64), keys) for i in range(3)]
    seen = np.bincount((at[0] * np.uint64(16) + at[1] * np.uint64(4) + at[2]).astype(np.int64), minlength=64)
    assert (seen > 0).sum() == 24 and (abs(seen[seen > 0] - 2500) < 250).all()  # five deviations


def test_enrichment_of_edges_that_are_not_saved(spark):
    rng = np.random.default_rng(3)
    rows = [(r, i, float(x), float(y), "AB"[int(i % 3 == 0)]) for r in ("x", "y") for i, (x, y) in enumerate(rng.random((50, 2)) * 40)]
    cells = spark.createDataFrame(rows, "roi_id string, cell_id long, x double, y double, cluster string")
    for edges in (neighbours.radius_edges(cells, radius_px=8.0), neighbours.knn_edges(cells, 3)):
        n = edges.count()
        assert sum(r.observed for r in spatial.enrichment(cells, edges, n_permutations=9).collect()) == n
        both = spatial.nhood_enrichment(cells, edges, n_permutations=9).collect()
        assert sum(r["count"] for r in both) == 2 * n


def test_enrichment_finds_neighbours_that_attract(spark):
    rows = [("x", i, float(i % 20) + (0.2 if i % 2 else 0.0), float(i // 20), "AB"[i // 200]) for i in range(400)]
    cells = spark.createDataFrame(rows, "roi_id string, cell_id long, x double, y double, cluster string")
    got = {(r.cluster_a, r.cluster_b): r for r in spatial.nhood_enrichment(cells, neighbours.radius_edges(cells, radius_px=1.5), n_permutations=50).collect()}
    assert got["A", "A"].z > 5 and got["B", "B"].z > 5 and got["A", "B"].z < -5


def test_permuted_counts_keep_sizes_and_split_regions_agree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    cells = spark.createDataFrame([(r, i, "ABC"[rng.integers(0, 3)] if i else None) for r in ("x", "y") for i in range(60)], "roi_id string, cell_id long, cluster string")
    pairs = sorted({tuple(sorted(p)) for p in rng.integers(0, 60, (150, 2)).tolist() if p[0] != p[1]})
    edges = spark.createDataFrame([(r, a, b) for r in ("x", "y") for a, b in pairs], "roi_id string, src long, dst long")
    whole = sorted(map(tuple, spatial.pair_counts(cells, edges, "cluster", 6, 1).collect()))
    assert sorted(map(tuple, spatial.pair_counts(cells.repartition(5), edges, "cluster", 6, 1).collect())) == whole
    for most in (70, 10):  # counts are sent on region by region, and as they come
        monkeypatch.setattr(spatial, "COUNTS_OF_A_TASK", most)
        assert sorted(map(tuple, spatial.pair_counts(cells, edges.repartition(3), "cluster", 6, 1).collect())) == whole
    few = spatial.permuted_labels(cells, "cluster", 6, 1)[0].collect()
    sizes = [{r: sorted(x.labels[p] for x in few if x.roi_id == r) for r in "xy"} for p in range(7)]
    assert all(s == sizes[0] for s in sizes)
    label = {(r.roi_id, r.cell_id): r.cluster for r in cells.collect() if r.cluster}
    want = {}
    for r in ("x", "y"):
        for a, b in pairs:
            if (r, a) in label and (r, b) in label:
                key = (r, *sorted((label[r, a], label[r, b])))
                want[key] = want.get(key, 0) + 1
    assert {w[1:4]: w[4] for w in whole if w[0] == 0} == want
    for r in ("x", "y"):
        total = {p: sum(w[4] for w in whole if w[:2] == (p, r)) for p in range(7)}
        assert len(set(total.values())) == 1
    assert len({tuple(w[1:] for w in whole if w[0] == p) for p in range(7)}) == 7


def test_otsu_of_whole_numbers_has_a_bin_for_each_value(spark):
    values = [0] * 50 + [1] * 40 + [5] * 3 + [1000] * 20 + [1001] * 15
    rows = [("a", "c", i, 0, v) for i, v in enumerate(values)]
    whole = qc.otsu(spark.createDataFrame(rows, "acq_id string, channel string, y int, x int, value int")).first().threshold

    def between(t):
        low, high = [v for v in values if v <= t], [v for v in values if v > t]
        return len(low) * len(high) * (np.mean(low) - np.mean(high)) ** 2 if high else 0

    assert whole == max(sorted(set(values))[:-1], key=lambda t: (round(between(t), 6), -t)) == 5


def test_active_sets_equal_gradient_descent():
    rng = np.random.default_rng(9)
    s = np.eye(6) + rng.random((6, 6)) * 0.3 * (1 - np.eye(6))
    y = rng.normal(1, 2, (300, 6))
    exact = spillover.exact_unmix(y, s)
    assert (exact >= 0).all() and np.allclose(exact, spillover.unmix(y, s, 20_000), atol=1e-5)
    gain = (y - exact @ s.T) @ s
    assert (gain[exact == 0] < 1e-8).all() and np.allclose(gain[exact > 0], 0, atol=1e-8)


def test_five_numbers_of_null_clusters(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", None)], "cluster string, v double")
    got = {r.cluster: (r.n, r.min, r.median, r.max) for r in statistics.five_numbers(df, ["v"]).collect()}
    assert got == {None: (2, 1.0, 2.0, 3.0), "a": (1, 5.0, 5.0, 5.0)}


def test_markers_of_values_that_differ_when_computed_again(spark):
    import random

    from pyspark.sql import functions as F

    shaken = F.udf(lambda x: x + random.random() * 1e-9, "double").asNondeterministic()
    df = spark.range(300).select(F.concat(F.lit("c"), F.col("id") % 3).alias("cluster"), shaken(F.col("id") * 7 % 101 + 1.0).alias("m"))
    got = statistics.marker_stats(df, ["m"]).collect()
    assert [r.n for r in got] == [100] * 3 and all(r.auroc is not None for r in got)


def test_fdr_by_sums_once_a_group(spark):
    from pyspark.sql import functions as F

    from histarium.operators import correlation

    for n in (1, 2, 1000, 1001, 30_000):
        assert spark.range(1).select(correlation.harmonic(F.lit(n))).first()[0] == pytest.approx(sum(1 / i for i in range(1, n + 1)), rel=1e-13)
    p = np.random.default_rng(5).random(1500)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(p)] + [("b", 0, 0.01), ("b", 1, None), ("c", 0, None)], "g string, k long, p double")
    got = {(r.g, r.k): r.p_adjusted for r in correlation.adjust_p(df, "fdr_by", ["g"]).collect()}
    order = np.argsort(p)
    raw = p[order] * 1500 * sum(1 / i for i in range(1, 1501)) / np.arange(1, 1501)
    want = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
    assert [got["a", int(i)] for i in order] == pytest.approx(want)
    assert got["b", 0] == pytest.approx(0.01) and got["b", 1] is None and got["c", 0] is None
