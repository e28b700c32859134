"""Agglomeration on tables and silhouettes against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from histarium.operators import clustering, hierarchy, rounds
from histarium.operators.silhouette import _first_hashes, silhouette, within_squares


def merge_one_by_one(points, sizes, n_clusters, linkage):
    """Cluster of each point; the nearest two clusters merge until so many are left."""
    n = len(points)
    d = ((points[:, None] - points[None]) ** 2).sum(2)
    d = d * 2 * sizes[:, None] * sizes / (sizes[:, None] + sizes) if linkage == "ward" else np.sqrt(d)
    d[np.arange(n), np.arange(n)] = np.inf
    size, of, alive = sizes.astype(float), np.arange(n), np.ones(n, bool)
    best = d.min(1)
    for _ in range(n - n_clusters):
        i = int(best.argmin())
        j = int(d[i].argmin())
        row = {"complete": np.maximum(d[i], d[j]), "average": (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])}.get(linkage)
        if row is None:
            row = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        size[i] += size[j]
        alive[j], of[of == j] = False, i
        row[~alive], row[i] = np.inf, np.inf
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
        best = d.min(1)
    return of


def parts(labels) -> set:
    groups = {}
    for i, c in enumerate(labels):
        groups.setdefault(c, []).append(i)
    return {tuple(g) for g in groups.values()}


@pytest.mark.parametrize("linkage", ["ward", "complete", "average"])
@pytest.mark.parametrize("n, k", [(2000, 12), (60, 1)])
def test_tree_equals_plain_agglomeration(spark, linkage, n, k):
    rng = np.random.default_rng(n)
    points = rng.normal(size=(n, 3)) * rng.uniform(0.2, 3, size=(n, 1))
    again = rng.integers(0, n, n // 2)
    rows = [(int(i), *map(float, points[i])) for i in (*range(n), *again)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double")
    got = {r.k: r.cluster for r in clustering.hierarchical(df, ["a", "b", "c"], k, linkage, micro=None).collect()}
    sizes = 1 + np.bincount(again, minlength=n)
    assert parts([got[i] for i in range(n)]) == parts(merge_one_by_one(points, sizes, k, linkage))


def test_ties_chains_and_few_points(spark):
    line = spark.createDataFrame([(i, float(2**i)) for i in range(12)], "k int, a double")  # one merger a round
    got = {r.k: r.cluster for r in clustering.hierarchical(line, ["a"], 3, "complete", micro=None).collect()}
    assert parts([got[i] for i in range(12)]) == {tuple(range(10)), (10,), (11,)}
    grid = spark.createDataFrame([(float(x), float(y)) for x in range(8) for y in range(8)], "a double, b double")
    found = clustering.hierarchical(grid, ["a", "b"], 4, "average", micro=None).groupBy("cluster").count().collect()
    assert len(found) == 4 and sum(r["count"] for r in found) == 64
    same = spark.createDataFrame([(1.0,), (1.0,), (None,), (float("nan"),)], "a double")
    assert sorted(r.cluster for r in clustering.hierarchical(same, ["a"], 1, micro=None).collect()) == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        clustering.hierarchical(same, ["a"], 2)
    with pytest.raises(ValueError):
        clustering.hierarchical(same, ["a"], 1, "single")


@pytest.mark.parametrize("linkage", ["ward", "complete", "average"])
@pytest.mark.parametrize("k, table, near", [(12, 40, 0.0), (5, 300, 1e4)])
def test_more_cells_than_a_table_holds(spark, monkeypatch, linkage, k, table, near):
    monkeypatch.setattr(hierarchy, "TABLE", table)
    monkeypatch.setattr(rounds, "BLOCK", 160)  # clusters of over 20 cells are cut
    monkeypatch.setattr(rounds, "STRIP", 30)
    rng = np.random.default_rng(k)
    points = np.r_[rng.normal(size=(150, 3)) * 0.05, rng.normal(size=(450, 3)) * rng.uniform(0.2, 3, size=(450, 1))] + near
    points[-4:] += [[900, 0, 0], [910, 0, 0], [0, 700, 0], [0, 705, 0]]  # merge early, and highest
    again = rng.integers(0, 600, 300)
    df = spark.createDataFrame([(int(i), *map(float, points[i])) for i in (*range(600), *again)] + [(-1, None, 1.0, 1.0)], "k long, a double, b double, c double")
    got = {r.k: r.cluster for r in clustering.hierarchical(df, ["a", "b", "c"], k, linkage, micro=None).collect()}
    assert got.pop(-1) == 0
    assert parts([got[i] for i in range(600)]) == parts(merge_one_by_one(points, 1 + np.bincount(again, minlength=600), k, linkage))
    first = [got[i] for i in np.lexsort(points.T[::-1])]
    assert sorted(set(first)) == list(range(1, k + 1)) == sorted(set(first), key=first.index)


def plain_silhouette(x, labels):
    out = np.zeros(len(x))
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        mine = labels == labels[i]
        if mine.sum() > 1:
            a, b = d[mine].sum() / (mine.sum() - 1), min(d[labels == c].mean() for c in set(labels) - {labels[i]})
            out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return out


def test_silhouette_and_squares(spark):
    rng = np.random.default_rng(1)
    labels = np.array([1] * 150 + [2] * 120 + [3] * 29 + [4])
    x = rng.normal(size=(300, 4)) + 2.0 * labels[:, None] + 1e4  # far from the origin
    x[7] = x[8]
    rows = [(int(c), *map(float, r)) for c, r in zip(labels, x, strict=True)] + [(0, 1.0, 1.0, 1.0, 1.0), (2, None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "cluster int, a double, b double, c double, d double")
    cols, want = list("abcd"), plain_silhouette(x, labels)
    got = {r.cluster: (r.n, r.silhouette) for r in silhouette(df, cols).collect()}
    assert got[None] == (300, pytest.approx(want.mean(), abs=1e-9))
    for c in (1, 2, 3, 4):
        assert got[c] == ((labels == c).sum(), pytest.approx(want[labels == c].mean(), abs=1e-9))
    part = {r.cluster: (r.n, r.silhouette) for r in silhouette(df, cols, sample=150).collect()}
    assert part[None] == (300, pytest.approx(want.mean(), abs=0.05))
    squares = {r.cluster: r.wcss for r in within_squares(df, cols).collect()}
    for c in (1, 2, 3, 4):
        held = x[labels == c]
        assert squares[c] == pytest.approx(((held - held.mean(0)) ** 2).sum(), abs=1e-5)
    lone = silhouette(df.filter("cluster = 1"), cols).filter("cluster is null").first()
    assert (lone.n, lone.silhouette) == (150, 0.0)
    assert silhouette(df.limit(0), cols).filter("cluster is null and silhouette is not null").count() == 0


def test_sample_of_hashes_does_not_come_from_each_task(spark):
    df = spark.range(0, 40_000, 1, 40).select(F.struct(F.xxhash64(F.lit(3), "id").alias("h"), F.col("id").alias("_id")).alias("_h"))
    want = sorted(tuple(r["_h"]) for r in df.collect())
    for sample in (500, 39_990, 50_000):
        assert [tuple(r["_h"]) for r in _first_hashes(df, sample)] == want[:sample]
    asked = []

    class Asked:
        count = staticmethod(df.count)

        def filter(self, which):
            asked.append(df.filter(which).count())
            return df.filter(which)

    _first_hashes(Asked(), 500)
    assert len(asked) == 1 and asked[0] < 1000  # not 500 of each of 40 tasks
    same = df.select(F.struct(F.lit(2**62).alias("h"), F.col("_h._id").alias("_id")).alias("_h"))
    assert [r["_h"]["_id"] for r in _first_hashes(same, 3)] == [0, 1, 2]


@pytest.mark.parametrize("method", ["kmeans", "hierarchical"])
@pytest.mark.parametrize("metric", ["euclidean", "squared"])
def test_k_search_finds_planted_number(spark, method, metric):
    rng = np.random.default_rng(3)
    rows = [(float(20 * (i % 3) + rng.normal()), float(30 * (i % 3 == 1) + rng.normal())) for i in range(120)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    found = {r.k: r for r in clustering.k_search(df, ["a", "b"], 2, 5, method=method, metric=metric).collect()}
    assert [k for k in found if found[k].best] == [3] and [k for k in found if found[k].elbow] == [3]
    assert all(found[k].wcss >= found[k + 1].wcss - 1e-9 for k in (2, 3, 4)) or method == "kmeans"
    wide = clustering.hierarchical(df, ["a", "b"], 3).groupBy("cluster").agg(F.count("*").alias("n")).collect()
    assert {(r.cluster > 0, r.n) for r in wide} == {(True, 40), (False, 1)}
