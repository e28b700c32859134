"""Joins whose sides grow with the cells are dealt by key, however small their files look."""

import numpy as np
import pytest

from histarium.operators import batches, neighbours, spatial


def test_cells_are_not_broadcast(spark, tmp_path):
    rows = [("a", i, float(i % 7), float(i // 7), f"c{i % 3}") for i in range(50)]
    spark.createDataFrame(rows, "roi_id string, cell_id long, x double, y double, cluster string").write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")
    edges = neighbours.radius_edges(cells, radius_px=2.0)
    joined = [
        edges,
        spatial.with_labels(edges, cells, "cluster"),
        spatial.edge_distances(cells, edges),
        spatial.co_occurrence(cells, [0.0, 1.0, 2.0]),
        spatial.neighborhood_composition(cells, edges, ["c0", "c1", "c2"]),
        spatial.spatial_layout(cells, edges, "cluster")[1],
        neighbours.match_centroids(cells.drop("cluster"), cells, "cluster"),
    ]
    for df in joined:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() > 0


def test_axes_do_not_grow_the_plan(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 12)) @ rng.normal(size=(12, 12)) + 5
    names = [f"e{i}" for i in range(12)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, " + ", ".join(f"{c} double" for c in names))
    means, axes, values = batches.principal_axes(df, names, None, 12)
    assert means == pytest.approx(x.mean(0)) and values == pytest.approx(np.linalg.eigvalsh(np.cov(x.T))[::-1])
    held = batches.project(df, names, means, axes, "_z")
    back = batches.unproject(held.selectExpr("*", "transform(_z, z -> 2 * z) as _n"), names, means, axes, "_z", "_n").select(*df.columns)
    assert np.array([r[1:] for r in back.orderBy("k").collect()]) == pytest.approx(2 * x - x.mean(0))
    assert len(back._jdf.queryExecution().analyzed().toString()) < 12_000
    gaps = df.selectExpr("k", "if(k = 3, null, e0) as e0", "e1")
    z = batches.project(gaps, ["e0", "e1"], np.zeros(2), np.eye(2), "_z").filter("k = 3").first()._z
    cov = batches.principal_axes(gaps, ["e0", "e1"], None, 2)[2]
    own = np.delete(x[:, :2], 3, 0)
    full = np.cov(own.T)
    full[1, 1] = x[:, 1].var(ddof=1)
    assert z == [None, None] and cov == pytest.approx(np.linalg.eigvalsh(full)[::-1])


def test_pairs_are_met_by_place(spark):
    rng = np.random.default_rng(3)
    rows = [("a", i, float(rng.integers(5)), float(rng.integers(5)), f"c{rng.integers(3)}") for i in range(300)] + [("a", 900, None, 1.0, "c0"), ("a", 901, float("nan"), 1.0, "c0")]
    cells = spark.createDataFrame(rows, "roi_id string, cell_id long, x double, y double, cluster string")
    for same in (True, False):
        near = spatial._pairs_within(cells, "cluster", 1.5, same)
        want = {}
        for _, i, x, y, a in rows[:300]:
            for _, j, u, w, b in rows[:300]:
                d = np.hypot(x - u, y - w)
                if i != j and d <= 1.5 and (a == b or not same):
                    want[a, b, round(d, 6)] = want.get((a, b, round(d, 6)), 0) + 1
        assert near.count() < 1600
        got = {}
        for r in near.collect():
            got[r.a, r.b, round(r.distance, 6)] = got.get((r.a, r.b, round(r.distance, 6)), 0) + r.pairs
        assert got == want
