"""Micro fixtures with known answers, invariants and planted structure."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from histarium.functions import columns
from histarium.functions.tails import incomplete_beta, t_two_sided_value
from histarium.operators.gabriel import gabriel_edges
from histarium.operators import batches, clustering, correlation, features, gates, neighbours, qc, scaling, spatial, spillover, stencils
from histarium.operators.components import connected_components
from histarium.sources import io

SQUARES = {1: (10, 10), 2: (40, 40), 3: (70, 20), 4: (20, 70), 5: (60, 60)}


@pytest.fixture(scope="module")
def mask(spark):
    rows = [("a", y, x, c) for c, (y0, x0) in SQUARES.items() for y in range(y0, y0 + 20) for x in range(x0, x0 + 20)]
    return spark.createDataFrame(rows, "acq_id string, y int, x int, cell_id int").cache()


@pytest.fixture(scope="module")
def pixels(spark):
    rng = np.random.default_rng(42)
    rows = [("a", c, y, x, float(rng.integers(0, 1000))) for c in ("DAPI", "CD3") for y in range(100) for x in range(100)]
    return spark.createDataFrame(rows, "acq_id string, channel string, y int, x int, value double").cache()


def test_square_cells_have_known_shapes(mask):
    got = {r.cell_id: r for r in features.morphology(mask).join(features.solidity(mask), features.CELL).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    for c, (y, x) in SQUARES.items():
        r = got[c]
        assert (r.area_um2, r.extent, r.solidity, r.bbox_area_um2) == (400, 1, 1, 400)
        assert (r.centroid_x, r.centroid_y) == (x + 9.5, y + 9.5)
        assert r.eccentricity == pytest.approx(0, abs=1e-6) and r.aspect_ratio == pytest.approx(1)
        assert r.equivalent_diameter_um == pytest.approx(math.sqrt(1600 / math.pi))


def test_square_perimeter(mask):
    r = features.perimeter(mask).first()
    assert r.perimeter_um == pytest.approx(76) and r.circularity == pytest.approx(4 * math.pi * 400 / 76**2)


def test_perimeter_of_cells_across_squares(spark):
    rng = np.random.default_rng(5)
    cells = np.kron(rng.integers(0, 4, (15, 15)), np.ones((20, 20), int)) * (rng.random((300, 300)) < 0.97)
    rows = [("a", int(y), int(x), int(cells[y, x])) for y, x in np.argwhere(cells > 0)]
    found = features.perimeter(spark.createDataFrame([*rows, ("b", 0, 0, 1)], "acq_id string, y int, x int, cell_id int"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # pixels are dealt out once
    got = {(r.acq_id, r.cell_id): r.perimeter_um for r in found.collect()}
    assert got.pop(("b", 1)) == 0.0 and len(got) == 3
    for c in (1, 2, 3):
        own = np.pad(cells == c, 1)
        at = lambda im, d: np.roll(im, (-d[0], -d[1]), (0, 1))
        border = own & ~np.logical_and.reduce([at(own, d) for d in features.SIDES])
        code = 1 + sum(2 * at(border, d).astype(int) for d in features.SIDES) + sum(10 * at(border, d).astype(int) for d in features.CORNERS)
        assert got["a", c] == pytest.approx(sum(v * (border & np.isin(code, k)).sum() for v, k in features.PERIMETER.items()))


def test_masks_of_the_queries_are_made_by_all_tasks(spark):
    from histarium.queries import views

    assert views.mask(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_hull_of_an_l_shape(spark):
    cells = [("a", y, 0, 1) for y in range(5)] + [("a", 4, x, 1) for x in range(1, 5)]
    r = features.solidity(spark.createDataFrame(cells, "acq_id string, y int, x int, cell_id int")).first()
    assert 0.5 < r.solidity < 0.75


def test_intensities_equal_numpy(pixels, mask):
    labelled = features.in_cells(pixels, mask)
    values = {}
    for r in labelled.select("cell_id", "channel", "value").collect():
        values.setdefault((r.cell_id, r.channel), []).append(r.value)
    for r in features.intensity_long(labelled).collect():
        v = np.array(values[r.cell_id, r.channel])
        assert np.allclose([r.mean, r.std, r.median, r.p10, r.p90, r.integrated, r.frac_pos], [v.mean(), v.std(), np.median(v), *np.percentile(v, [10, 90]), v.sum(), (v > 0).mean()])
        assert r.mad == pytest.approx(np.median(np.abs(v - np.median(v))))


def test_qc_ranges(pixels, mask):
    for r in qc.qc_pixel(pixels).collect():
        assert r.intensity_min <= r.threshold <= r.intensity_max and 0 < r.coverage < 1 and r.signal_mean > r.background_mean
    assert {r.n_cells for r in qc.qc_cell(pixels, mask).collect()} == {5}
    assert qc.qc_cell(pixels, mask).first().coverage == pytest.approx(0.2)


def test_flat_images(spark):
    flat = spark.createDataFrame([("a", "c", y, x, 3.0) for y in range(4) for x in range(4)], "acq_id string, channel string, y int, x int, value double")
    assert {r.value for r in scaling.minmax(flat).collect()} == {0.0}
    assert {r.value for r in scaling.percentile_clip(flat).collect()} == {0.0}
    assert qc.qc_pixel(flat).first().coverage == 0
    assert {r.value for r in stencils.median_filter(flat).collect()} == {3.0}
    assert {round(r.value, 9) for r in stencils.gaussian_blur(flat, 1.2).collect()} == {3.0}


def test_tiles_give_the_same_as_one_block(spark):
    rng = np.random.default_rng(1)
    image = rng.random((20, 17))
    df = spark.createDataFrame([("a", "c", y, x, float(image[y, x])) for y in range(20) for x in range(17)], "acq_id string, channel string, y int, x int, value double")
    small, large = (stencils.by_tiles(df, lambda im, _: stencils._extreme(im, stencils.disk(2), np.minimum), 2, size=s) for s in (5, 64))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    a, b = ({(r.y, r.x): r.value for r in stencils.richardson_lucy(df, size=s).collect()} for s in (8, 64))
    assert set(a) == {(y, x) for y in range(14) for x in range(11)} and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    opened = {(r.y, r.x): r.value for r in stencils.opening(df, 2).collect()}
    assert all(opened[y, x] <= image[y, x] + 1e-12 for y in range(20) for x in range(17))


def test_segmentation_finds_planted_squares(spark, mask):
    own = {(r.y, r.x) for r in mask.collect()}
    df = spark.createDataFrame([("a", "n", y, x, 9.0 if (y, x) in own else 1.0) for y in range(100) for x in range(100)], "acq_id string, channel string, y int, x int, value double")
    found = stencils.threshold_segment(df, ["n"])
    # squares 2 and 5 touch nowhere; five regions of 400 pixels
    assert sorted(r["count"] for r in found.groupBy("cell_id").count().collect()) == [400] * 5


def test_gates_first_match_wins_and_values_stay(spark):
    df = spark.createDataFrame([(1, 5.0, "kept"), (2, 5.0, ""), (3, None, None), (4, 1.0, None)], "id int, v double, manual_phenotype string")
    rules = [{"name": "hi", "logic": "AND", "conditions": [{"column": "v", "op": ">", "threshold": 4.0}]}, {"name": "any", "logic": "OR", "conditions": [{"column": "v", "op": ">=", "threshold": 1.0}, {"column": "w", "op": "<", "threshold": 0.0}]}, {"name": "odd", "logic": "AND", "conditions": [{"column": "v", "op": "~", "threshold": 0.0}]}]
    assert [r.manual_phenotype for r in gates.apply_gates(df, rules).orderBy("id").collect()] == ["kept", "hi", "", "any"]


def test_tails():
    assert t_two_sided_value(1.0, 1) == pytest.approx(0.5) and t_two_sided_value(0.0, 7) == pytest.approx(1)


@settings(max_examples=60, deadline=None)
@given(st.floats(0.01, 0.99), st.floats(0.5, 60), st.floats(0.5, 60))
def test_incomplete_beta_is_symmetric(x, a, b):
    assert incomplete_beta(x, a, b) == pytest.approx(1 - incomplete_beta(1 - x, b, a), abs=1e-9)


def test_adjusted_p_is_monotone(spark):
    p = [0.01, 0.04, 0.03, 0.2, None, 0.9]
    got = correlation.adjust_p(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")).orderBy("i").collect()
    assert [None if r.p_adjusted is None else round(r.p_adjusted, 6) for r in got] == [0.05, 0.066667, 0.066667, 0.25, None, 0.9]


def test_spearman_with_gaps_and_perfect_order(spark):
    rows = [("a", c, 0, x, float(v)) for x in range(12) for c, v in (("p", x), ("q", x**3), ("r", -x))] + [("a", "p", 1, 0, float("nan")), ("a", "q", 1, 0, 5.0)]
    got = {(r.channel_a, r.channel_b): r for r in correlation.pixel_correlation(spark.createDataFrame(rows, "acq_id string, channel string, y int, x int, value double")).collect()}
    assert got["p", "q"].r == pytest.approx(1) and got["p", "r"].r == pytest.approx(-1) and got["p", "q"].n == 12 and got["p", "q"].p == 0


def plain_rank(v):
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def test_spearman_of_every_pattern_of_gaps(spark):
    rng = np.random.default_rng(5)
    image = {(a, c): np.where(rng.random(80) < gone, np.nan, rng.integers(0, 9, 80) * 1.0) for a in ("a", "b", "lone") for c, gone in zip("pqrst", (0, 0, 0.2, 0.5, 0.99), strict=True) if a != "lone" or c == "p"}
    image["a", "u"] = np.full(80, 4.0)
    rows = [(a, c, i // 10, i % 10, float(x)) for (a, c), v in image.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "acq_id string, channel string, y int, x int, value double")
    got = {(r.acq_id, r.channel_a, r.channel_b): (r.n, r.r, r.p) for r in correlation.pixel_correlation(df).collect()}
    want = {}
    for (a, c), v in image.items():
        for (a2, c2), w in image.items():
            held = np.isfinite(v) & np.isfinite(w)
            if a == a2 and c < c2 and held.sum() >= 3:
                s, t = plain_rank(v[held]), plain_rank(w[held])
                want[a, c, c2] = held.sum(), np.corrcoef(s, t)[0, 1] if s.std() and t.std() else None
    assert got.keys() == want.keys() and any(r is None for _, r in want.values())
    for k, (n, r) in want.items():
        assert got[k][0] == n and (got[k][1:] == (None, None) if r is None else got[k][1] == pytest.approx(r) and 0 <= got[k][2] <= 1), k
    whole = df.filter("channel in ('p', 'q')")
    assert correlation.pixel_correlation(whole).collect() == correlation.pixel_correlation(whole, complete=True).collect()
    assert correlation.pixel_correlation(df.limit(0)).count() == 0


def test_first_component_equals_plain(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3)) @ np.array([[2.0, 1.0, 0.1], [0, 1, 0.3], [0, 0, 0.2]])
    rows = [("a", f"c{j}", i // 10, i % 10, float(x[i, j])) for i in range(60) for j in range(3)] + [("b", "c1", 0, i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "acq_id string, channel string, y int, x int, value double")
    got = {(r.acq_id, r.y * 10 + r.x): r.value for r in scaling.combine_channels(df, "pca1").collect()}
    centred = x - x.mean(0)
    axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    score = centred @ (axis * np.sign(axis[np.abs(axis).argmax()]))
    score = (score - score.min()) / np.ptp(score)
    assert all(got["a", i] == pytest.approx(score[i]) for i in range(60)) and [got["b", i] for i in range(5)] == [0, 0.25, 0.5, 0.75, 1]


def test_components_and_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (None, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def cells_frame(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(f"r{i % 3}", i, float(rng.integers(0, 60)) + (1000 if i % 50 == 0 else 0), float(rng.integers(0, 60)), "abc"[int(rng.integers(3))], float(rng.random())) for i in range(n)]
    return rows, spark.createDataFrame(rows, "roi_id string, cell_id long, x double, y double, cluster string, m double")


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_neighbours_equal_brute_force(spark, k):
    rows, df = cells_frame(spark)
    want = set()
    for r in rows:
        near = sorted((math.dist(r[2:4], o[2:4]), o[1]) for o in rows if o[0] == r[0] and o[1] != r[1])[:k]
        want |= {(r[0], min(r[1], o), max(r[1], o)) for _, o in near}
    assert {(r.roi_id, r.src, r.dst) for r in neighbours.knn_edges(df, k).collect()} == want


def test_spatial_invariants(spark):
    _, df = cells_frame(spark)
    edges = neighbours.radius_edges(df, radius_px=12.0).cache()
    shares = spatial.neighborhood_composition(df, edges, ["a", "b", "c"]).selectExpr("frac_a + frac_b + frac_c s").distinct().collect()
    assert all(min(abs(r.s), abs(r.s - 1)) < 1e-9 for r in shares)
    result = spatial.enrichment(df, edges, n_permutations=19).collect()
    assert sum(r.observed for r in result) == edges.count() and all(0 < r.p_value <= 1 for r in result)
    again = spatial.enrichment(df.repartition(7), edges.repartition(5), n_permutations=19).collect()
    assert sorted(map(tuple, result)) == sorted(map(tuple, again))
    gabriel = {(r.roi_id, r.src, r.dst) for r in gabriel_edges(df).filter("distance <= 12").collect()}
    assert gabriel < {(r.roi_id, r.src, r.dst) for r in edges.collect()}
    assert all(-1.2 < r.i < 1.2 and 0 <= r.p <= 1 for r in spatial.morans_i(df, edges, ["m"]).collect())


def test_unmixing_returns_what_was_mixed():
    rng = np.random.default_rng(0)
    s = np.eye(4) + np.triu(rng.random((4, 4)) * 0.2, 1)
    z = rng.random((30, 4)) * 100
    for orientation, m in (("reference", s), ("usual", s.T)):
        y = z @ m.T
        assert np.allclose(spillover.unmix(y, s, 3000, orientation=orientation), z, atol=1e-3)
        assert np.allclose(spillover.exact_unmix(y, s, orientation), z, atol=1e-6)
    y = rng.normal(size=(20, 4))
    assert np.allclose(spillover.exact_unmix(y, s), spillover.unmix(y, s, 20000, 0), atol=1e-4)


def test_spillmat_recovers_planted_spill(spark):
    rng = np.random.default_rng(5)
    rows, e = [], 0
    for bc in (0, 141, 142, 165):
        for _ in range(80):
            v = {"Pr141": 1.0, "Nd142": 1.0, "Ho165": 1.0}
            for c, m in (("Pr141", 141), ("Nd142", 142), ("Ho165", 165)):
                if m == bc:
                    v[c] += float(rng.uniform(100, 200))
            v["Nd142"] += 0.1 * (v["Pr141"] - 1)
            rows += [(e, bc, c, x) for c, x in v.items()]
            e += 1
    df = spark.createDataFrame(rows, "event_id long, bc_id int, channel string, value double")
    got = {(r.emitter, r.receiver): r.coeff for r in spillover.compute_spillmat(df, df.select("channel")).collect()}
    assert got["Pr141", "Nd142"] == pytest.approx(0.1, abs=0.01) and got["Nd142", "Pr141"] == 0 and got["Ho165", "Ho165"] == 1 and got["Pr141", "Ho165"] == 0


def planted(spark, shift=0.0):
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.normal(12 * (i % 3), 1)), float(rng.normal(9 * (i % 3 == 1), 1)), i % 3, i // 3 % 2) for i in range(150)]
    return spark.createDataFrame([(k, a + shift * b2, b + shift * b2, g, b2) for k, a, b, g, b2 in rows], "k long, a double, b double, g int, batch int")


def pure(df, column="cluster") -> bool:
    return all(r.n == 1 for r in df.filter(F.col(column) != 0).groupBy(column).agg(F.count_distinct("g").alias("n")).collect())


def test_clusterings_keep_planted_groups_apart(spark):
    df = planted(spark)
    for found in (clustering.kmeans(df, ["a", "b"], 3, 2), clustering.hierarchical(df, ["a", "b"], 3, micro=30), clustering.graph_cluster(df, "k", ["a", "b"])):
        assert pure(found) and found.count() == 150
    assert pure(clustering.density_clusters(df, "k", ["a", "b"]))


def test_combat_and_harmony_bring_batches_together(spark):
    df = planted(spark, 4.0)
    gap = lambda x: abs(np.subtract(*[r.m for r in x.groupBy("batch").agg(F.avg("a").alias("m")).orderBy("batch").collect()]))
    before = gap(df)
    assert gap(batches.combat(df, "batch", ["a", "b"])) < 0.2 * before
    assert gap(batches.harmony(df, "batch", ["a", "b"], n_clusters=6, share=0.999)) < before
    assert gap(batches.bbknn_smooth(df, "k", "batch", ["a", "b"])) < before


def test_column_roles(spark):
    df = spark.createDataFrame([(1, "f", 1.0, 2.0, 3.0, 4.0, 5.0)], "cell_id int, source_file string, centroid_x double, DAPI_mean double, DAPI_std double, area_um2 double, odd double")
    assert columns.feature_columns(df) == ["centroid_x", "DAPI_mean", "DAPI_std", "area_um2", "odd"]
    assert columns.feature_columns(df, include_centroids=False) == ["DAPI_mean", "DAPI_std", "area_um2", "odd"]
    assert columns.feature_columns(df, "suffix") == ["DAPI_mean", "DAPI_std", "area_um2"]
    assert columns.feature_columns(df, "suffix", include_morphology=False) == ["DAPI_mean", "DAPI_std"]
    assert columns.feature_columns(df, "numeric") == ["cell_id", "centroid_x", "DAPI_mean", "DAPI_std", "area_um2", "odd"]
    assert columns.classify_columns(df)["other_intensity"] == ["DAPI_std"]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "one.csv").write_text("cell_id,DAPI_mean\n1,2.5\n2,3.5\n")
    (tmp_path / "two.csv").write_text("cell_id,CD3_mean\n1,7.5\n")
    both = io.read_many(spark, [f"{tmp_path}/one.csv", f"{tmp_path}/two.csv"])
    assert both.count() == 3 and {r.source_file for r in both.collect()} == {"one.csv", "two.csv"}
    (tmp_path / "s.csv").write_text(",A,B\nA,1,0.1\nB,0,1\n")
    assert {(r.emitter, r.receiver): r.coeff for r in io.read_spill_matrix(spark, f"{tmp_path}/s.csv").collect()}["A", "B"] == 0.1
    (tmp_path / "bad.csv").write_text(",A,B\nA,1,0.1\n")
    with pytest.raises(ValueError):
        io.read_spill_matrix(spark, f"{tmp_path}/bad.csv")
    for i in range(2):
        io.append_run_log(spark, f"{tmp_path}/log", "cluster", f"op{i}", {"k": i})
    assert sorted(r.operation for r in io.read_run_log(spark, f"{tmp_path}/log").collect()) == ["op0", "op1"]
    rows, df = cells_frame(spark, 30)
    io.write_by_roi(df, neighbours.radius_edges(df, radius_px=20.0), f"{tmp_path}/rois")
    assert spark.read.parquet(f"{tmp_path}/rois/cells").count() == 30
    assert io.companion("/x/y.csv", "_qc") == "/x/y_qc.csv"


@pytest.mark.parametrize("how", [np.minimum, np.maximum])
def test_extremes_of_chords_equal_all_shifts(how):
    rng = np.random.default_rng(2)
    for radius in range(1, 21):
        image = rng.random((int(rng.integers(radius + 1, 60)), int(rng.integers(radius + 1, 60))))
        assert (stencils.disk_extreme(image, radius, how) == stencils._extreme(image, stencils.disk(radius), how)).all()


def test_regions_across_tiles_equal_a_plain_fill(spark):
    rng = np.random.default_rng(6)
    images = {"a": rng.random((23, 31)) < 0.6, "b": np.ones((9, 9), bool), "c": np.zeros((4, 4), bool)}
    snake = np.zeros((17, 17), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    images["d"] = snake
    want = {}
    for k, on in images.items():
        for y, x in zip(*np.nonzero(on), strict=True):
            if (k, y, x) not in want:
                todo = [(y, x)]
                while todo:
                    p = todo.pop()
                    if 0 <= p[0] < on.shape[0] and 0 <= p[1] < on.shape[1] and on[p] and (k, *p) not in want:
                        want[(k, *p)] = (y, x)
                        todo += [(p[0] + i, p[1] + j) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))]
    df = spark.createDataFrame([(k, int(y), int(x)) for k, on in images.items() for y, x in zip(*np.nonzero(on), strict=True)], "acq_id string, y int, x int")
    for size in (5, 256):
        got = {(r.acq_id, r.y, r.x): (r.region.y, r.region.x) for r in stencils.label_regions(df.repartition(3), size).collect()}
        assert got == {k: (int(v[0]), int(v[1])) for k, v in want.items()}


def test_pixels_are_dealt_to_cells_once(spark):
    from histarium.operators import features

    df = spark.createDataFrame([("a", 1, "c", 1.0), ("a", 1, "d", 2.0), ("a", 2, "c", 3.0)], "acq_id string, cell_id long, channel string, value double")
    wide = features.intensity_wide(features.intensity_long(df), ["c", "d"])
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert {(r.cell_id, r.c_mean, r.d_mean) for r in wide.collect()} == {(1, 1.0, 2.0), (2, 3.0, None)}


def test_spillmat_measures_events_few_times(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(v):
        seen.add(1)
        return v

    masses, rng = {"Nd142": 142, "Nd143": 143, "Gd158": 158, "Yb174": 174}, np.random.default_rng(9)
    rows = [(i, b, c, float(rng.integers(0, 50) + 200 * (m == b))) for i, b in enumerate([0, 142, 143, 158, 174] * 60) for c, m in masses.items()]
    events = spark.createDataFrame(rows, "event_id int, bc_id int, channel string, value double")
    want = {(r.emitter, r.receiver): r.coeff for r in spillover.compute_spillmat(events, events.select("channel")).collect()}
    counting = events.withColumn("value", F.udf(told, "double")("value"))
    got = {(r.emitter, r.receiver): r.coeff for r in spillover.compute_spillmat(counting, events.select("channel")).collect()}
    assert got == pytest.approx(want)
    assert seen.value <= 3 * len(rows), seen.value / len(rows)
