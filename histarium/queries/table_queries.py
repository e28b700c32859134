"""Queries on filters, segmentation, spillover, batches, clustering and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches, clustering, spillover, stencils
from ..operators.neighbours import knn_features, radius_edges
from ..operators.silhouette import silhouette, within_squares
from ..sources import io
from . import filter_sql
from . import views as v
from .views import CELLS, GRID, rounded

OFFSETS = "o AS (SELECT unnest(range(-1, 2)) AS dy), p AS (SELECT unnest(range(-1, 2)) AS dx)"
NEAREST = f"""{OFFSETS}, n AS (SELECT g.acq_id, g.channel, g.y, g.x, g.value, dy, dx, s.value AS v FROM grid g, o, p, grid s WHERE s.acq_id = g.acq_id AND
  s.channel = g.channel AND s.y = greatest(least(g.y + dy, 7), 0) AND s.x = greatest(least(g.x + dx, 7), 0))"""
ALL = [f"e{i}" for i in range(v.DIMS)]
VECTORS = "vec AS (SELECT vec_id, label, vec_id % 3 AS batch, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(v.DIMS)) + " FROM embeddings)"
PLACE = "acq_id, channel, y::BIGINT AS y, x::BIGINT AS x"
DONORS = "donors AS (SELECT DISTINCT acq_id, 'ch' || (acq_id::INT % 4) AS donor FROM grid)"
SPILL_ROWS = f"""{DONORS}, d AS (SELECT acq_id, y, x, donor, value AS d FROM grid JOIN donors USING (acq_id) WHERE channel = donor), q AS (SELECT acq_id,
  quantile_cont(d, 0.9) AS lo, quantile_cont(d, 0.999) AS hi FROM d GROUP BY ALL), f AS (SELECT d.* FROM d JOIN q USING (acq_id) WHERE d >= lo AND d
  <= hi),
 rows_ AS (SELECT acq_id, donor AS emitter, channel AS receiver, CASE WHEN donor = channel THEN 1.0 ELSE least(greatest(sum(d * value) / (sum(d * d)
  + 1e-12), 0), 0.3) END AS coeff, count(*) AS pixels FROM f JOIN grid USING (acq_id, y, x) GROUP BY acq_id, donor, channel)"""
SPILL_MATRIX = """matrix AS (SELECT e.c AS emitter, r.c AS receiver, CASE WHEN e.c = r.c THEN 1.0 ELSE coalesce(median(rows_.coeff), 0) END AS coeff FROM (SELECT
  DISTINCT channel AS c FROM grid) e CROSS JOIN (SELECT DISTINCT channel AS c FROM grid) r LEFT JOIN rows_ ON emitter = e.c AND receiver = r.c GROUP
  BY e.c, r.c)"""


def _donors(s, d):
    return v.grid(s, d).select("acq_id").distinct().select("acq_id", F.concat(F.lit("ch"), F.col("acq_id").cast("int") % 4).alias("donor"))


def _rows(s, d):
    return spillover.spill_rows(v.grid(s, d), _donors(s, d))


def _matrix(s, d):
    return spillover.spill_matrix(_rows(s, d), v.grid(s, d).select("channel"))


def _channels(s, d):
    """Channels named by isotopes, from the parts' keys: masses 139 to 176."""
    mass = F.col("p_partkey") % 38 + 139
    metal = F.element_at(F.array(*[F.lit(m) for m in ("Nd", "Gd", "Yb")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return v.read(s, d, "part").select(F.concat(metal, mass.cast("string")).alias("channel")).distinct()


CHANNEL_SQL = "ch AS (SELECT DISTINCT ['Nd', 'Gd', 'Yb'][(p_partkey % 3) + 1] AS metal, p_partkey % 38 + 139 AS mass FROM part), iso AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {x})" for m in ("Nd", "Gd", "Yb") for x in spillover.ISOTOPES[m]) + ") t(metal, isotope))"
BARCODES = ["Nd142", "Nd143", "Gd158", "Gd160", "Yb174"]


def _events(s, d):
    """Stained events from line items: five channels, the barcode from the order's key."""
    masses = F.array(*[F.lit(m) for m in (0, 142, 143, 158, 160, 174)])
    t = v.read(s, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("event_id"), F.element_at(masses, (F.col("l_orderkey") % 6 + 1).cast("int")).alias("bc_id"), *[(F.col(c) * (1 + (F.col("l_orderkey") % 6 == i + 1).cast("int") * 3)).alias(n) for i, (n, c) in enumerate(zip(BARCODES, ("l_quantity", "l_linenumber", "l_discount", "l_tax", "l_suppkey"), strict=True))])
    return t.unpivot(["event_id", "bc_id"], BARCODES, "channel", "value")


MASS = {c: int(c[2:]) for c in BARCODES}
SPILLS = {a: [b for b in BARCODES if b != a and (MASS[b] - MASS[a] in (-1, 1, 16) or MASS[b] in spillover.ISOTOPES[a[:2]])] for a in BARCODES}


def _spillmat_sql(method: str, trim: float) -> str:
    """Backgrounds, ratios and matrix of the five barcoded channels; the plan of pairs follows from their masses."""
    plan = []
    for a in BARCODES:
        for b in SPILLS[a]:
            out_a = {0, MASS[a], *(MASS[c] for c in SPILLS[a])}
            plan.append((a, b, MASS[a], sorted(out_a), sorted(out_a | {MASS[b], *(MASS[c] for c in SPILLS[b])})))
    rows = ", ".join(f"('{a}', '{b}', {m}, {x}, {y})" for a, b, m, x, y in plan)
    values = [f"{c} * (1 + 3 * (l_orderkey % 6 = {i + 1})::INT)" for i, c in enumerate(("l_quantity", "l_linenumber", "l_discount", "l_tax", "l_suppkey"))]
    events = f"""SELECT l_orderkey AS k, l_linenumber AS n, [0, 142, 143, 158, 160, 174][l_orderkey % 6 + 1] AS bc, unnest({BARCODES}) AS channel,
  unnest([{', '.join(f'({x})::DOUBLE' for x in values)}]) AS value FROM lineitem"""

    def trimmed(name: str, source: str) -> str:
        ranked = f"""SELECT emitter, receiver, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY emitter, receiver) AS n FROM ({source}) WINDOW w AS
  (PARTITION BY emitter, receiver ORDER BY value)"""
        return f"{name} AS (SELECT emitter, receiver, avg(value) AS m FROM ({ranked}) WHERE i >= floor({trim}::DOUBLE * n) AND i < ceil({1 - trim}::DOUBLE * n) GROUP BY ALL)"

    bg_i = trimmed("bg_i", "SELECT p.*, value FROM ev JOIN p ON channel = emitter WHERE NOT list_contains(out_i, bc)")
    bg_j = trimmed("bg_j", "SELECT p.*, value FROM ev JOIN p ON channel = receiver WHERE NOT list_contains(out_j, bc)")
    if method == "classic":
        found = f"""{trimmed("m_i", "SELECT p.*, value FROM ev JOIN p ON bc = donor AND channel = emitter")},
  {trimmed("m_j", "SELECT p.*, value FROM ev JOIN p ON bc = donor AND channel = receiver")},
 c AS (SELECT emitter, receiver, CASE WHEN m_i.m - coalesce(bg_i.m, 0) > 0 THEN greatest(m_j.m - coalesce(bg_j.m, 0), 0) / (m_i.m - coalesce(bg_i.m,
  0)) ELSE 0 END AS c FROM m_i JOIN m_j USING (emitter, receiver) LEFT JOIN bg_i USING (emitter, receiver) LEFT JOIN bg_j USING (emitter, receiver))"""
    else:
        found = """c AS (SELECT p.emitter, p.receiver, median(greatest(b.value - coalesce(bg_j.m, 0), 0) / greatest(a.value - coalesce(bg_i.m, 0), 1e-12)) AS c
  FROM p JOIN ev a ON a.bc = donor AND a.channel = p.emitter JOIN ev b ON b.k = a.k AND b.n = a.n AND b.channel = p.receiver
  LEFT JOIN bg_i ON bg_i.emitter = p.emitter AND bg_i.receiver = p.receiver LEFT JOIN bg_j ON bg_j.emitter = p.emitter AND bg_j.receiver = p.receiver GROUP BY ALL)"""
    return f"""WITH ev AS ({events}), p AS (SELECT * FROM (VALUES {rows}) t(emitter, receiver, donor, out_i, out_j)), {bg_i}, {bg_j}, {found}, n AS (SELECT
  unnest({BARCODES}) AS c)
SELECT e.c AS emitter, r.c AS receiver, round(CASE WHEN e.c = r.c THEN 1 WHEN c.c >= 1e-5 THEN c.c ELSE 0 END, 6) AS coeff FROM n e CROSS JOIN n r
  LEFT JOIN c ON emitter = e.c AND receiver = r.c"""


def _compensated(s, d):
    wide = v.cells(s, d).select("cell_id", *v.MARKERS)
    spill = v.even_spill(s, v.MARKERS)
    return spillover.compensate(wide, spill, {m: m for m in v.MARKERS}, method="nnls", cofactor=5.0)


def _knn_sql(metric: str) -> str:
    d = {"euclidean": "sqrt(" + " + ".join(f"(a.e{i} - b.e{i}) ** 2" for i in range(v.DIMS)) + ")", "cosine": "1 - (" + " + ".join(f"a.e{i} * b.e{i}" for i in range(v.DIMS)) + ") / sqrt((" + " + ".join(f"a.e{i} ** 2" for i in range(v.DIMS)) + ") * (" + " + ".join(f"b.e{i} ** 2" for i in range(v.DIMS)) + "))", "manhattan": " + ".join(f"abs(a.e{i} - b.e{i})" for i in range(v.DIMS))}[metric]
    return f"""WITH {VECTORS} SELECT vec_id, other, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS weight FROM (SELECT a.vec_id, b.vec_id AS other,
  {d} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {d}, b.vec_id) AS p FROM vec a JOIN vec b ON a.vec_id != b.vec_id) WHERE p < 6"""


QUERIES = {
    "n1_median_filter": (lambda s, d: rounded(stencils.median_filter(v.grid(s, d))), f"WITH {GRID}, {NEAREST} SELECT {PLACE}, round(median(v), 6) AS value FROM n WHERE dy = 0 OR dx = 0 GROUP BY ALL"),
    "n1_median_filter_square": (lambda s, d: rounded(stencils.median_filter(v.grid(s, d), stencils.SQUARE)), f"WITH {GRID}, {NEAREST} SELECT {PLACE}, round(median(v), 6) AS value FROM n GROUP BY ALL"),
    "n2_n_sd_local_median": (
        lambda s, d: rounded(stencils.n_sd_local_median(v.grid(s, d), 1.3)),
        f"""WITH {GRID}, {NEAREST}, m AS (SELECT acq_id, channel, y, x, value, median(v) AS m FROM n GROUP BY ALL), q AS (SELECT a.acq_id, a.channel, a.y, a.x,
  avg((b.value - b.m) ** 2) AS q FROM m a, o, p, m b WHERE b.acq_id = a.acq_id AND b.channel = a.channel AND b.y = greatest(least(a.y + dy, 7), 0)
  AND b.x = greatest(least(a.x + dx, 7), 0) GROUP BY ALL) SELECT {PLACE}, round(CASE WHEN value - m > 1.3 * sqrt(greatest(q, 1e-8)) THEN m ELSE value
  END, 6) AS value FROM m JOIN q USING (acq_id, channel, y, x)""",
    ),
    "n3_gaussian_blur": (lambda s, d: rounded(stencils.gaussian_blur(v.grid(s, d), 0.8)), filter_sql.BLUR),
    "n4_white_tophat": (
        lambda s, d: rounded(stencils.white_tophat(v.grid(s, d), 1)),
        f"""WITH {GRID}, {NEAREST}, e AS (SELECT acq_id, channel, y, x, value, min(v) AS e FROM n WHERE dy = 0 OR dx = 0 GROUP BY ALL) SELECT a.acq_id,
  a.channel, a.y::BIGINT AS y, a.x::BIGINT AS x, round(a.value - max(b.e), 6) AS value FROM e a, o, p, e b WHERE (dy = 0 OR dx = 0) AND b.acq_id =
  a.acq_id AND b.channel = a.channel AND b.y = greatest(least(a.y + dy, 7), 0) AND b.x = greatest(least(a.x + dx, 7), 0) GROUP BY a.acq_id,
  a.channel, a.y, a.x, a.value""",
    ),
    "n4_black_tophat": (lambda s, d: rounded(stencils.black_tophat(v.grid(s, d), 2)), filter_sql.BLACK),
    "n5_background_opening": (
        lambda s, d: rounded(stencils.background_opening(v.grid(s, d), 1)),
        f"""WITH {GRID}, {NEAREST}, e AS (SELECT acq_id, channel, y, x, value, min(v) AS e FROM n WHERE dy = 0 OR dx = 0 GROUP BY ALL) SELECT a.acq_id,
  a.channel, a.y::BIGINT AS y, a.x::BIGINT AS x, round(greatest(a.value - max(b.e), 0), 6) AS value FROM e a, o, p, e b WHERE (dy = 0 OR dx = 0) AND
  b.acq_id = a.acq_id AND b.channel = a.channel AND b.y = greatest(least(a.y + dy, 7), 0) AND b.x = greatest(least(a.x + dx, 7), 0) GROUP BY
  a.acq_id, a.channel, a.y, a.x, a.value""",
    ),
    "n6_rescale_to_max": (
        lambda s, d: rounded(stencils.rescale_to_max(v.grid(s, d).withColumn("value", F.abs("value")), v.grid(s, d))),
        f"""WITH {GRID}, k AS (SELECT acq_id, channel, min(value) AS a, max(value) AS b, max(abs(value)) AS m FROM grid GROUP BY ALL) SELECT {PLACE},
  round(least(greatest(abs(value) * b / m, least(a, 0)), b), 6) AS value FROM grid JOIN k USING (acq_id, channel)""",
    ),
    "n7_denoise": (lambda s, d: rounded(stencils.denoise(v.grid(s, d), {"ch0": {"hot": {"method": "n_sd_local_median", "n_sd": 3.0}, "speckle": {"method": "gaussian", "sigma": 0.8}}, "ch1": {"hot": {"method": "median3"}, "background": {"method": "opening", "radius": 3}}})), filter_sql.DENOISE),
    "n8_gradient_sobel": (
        lambda s, d: rounded(stencils.gradient_magnitude(v.grid(s, d))),
        f"""WITH {GRID}, {NEAREST}, g AS (SELECT acq_id, channel, y, x, sqrt((sum(v * dy * (2 - abs(dx)) / 8) ** 2 + sum(v * dx * (2 - abs(dy)) / 8) ** 2) / 2)
  AS g FROM n GROUP BY ALL) SELECT {PLACE}, round((g - min(g) OVER w) / (max(g) OVER w - min(g) OVER w), 6) AS value FROM g WINDOW w AS (PARTITION BY
  acq_id, channel)""",
    ),
    "n8_gradient_scharr": (lambda s, d: rounded(stencils.gradient_magnitude(v.grid(s, d), "scharr")), filter_sql.gradient((3, 10, 3))),
    "n8_gradient_inverse": (lambda s, d: rounded(stencils.gradient_magnitude(v.grid(s, d), "inverse")), f"""WITH {GRID} SELECT {PLACE}, round(1 - (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS value FROM grid WINDOW w AS
  (PARTITION BY acq_id, channel)"""),
    "n10_threshold_segment": (lambda s, d: rounded(stencils.threshold_segment(v.grid(s, d), ["ch0", "ch1"], min_area=3)), filter_sql.SEGMENT),
    "n11_tiles": (lambda s, d: stencils.tiles(v.grid(s, d), 4, 1).groupBy("ty", "tx", "y0", "x0").agg(F.count("*").alias("n")).transform(rounded), f"""WITH {GRID}, t AS (SELECT unnest(range(3)) AS t) SELECT a.t AS ty, b.t AS tx, a.t * 3 AS y0, b.t * 3 AS x0, count(*) AS n FROM grid, t a, t b WHERE y
  >= a.t * 3 AND y < a.t * 3 + 4 AND x >= b.t * 3 AND x < b.t * 3 + 4 GROUP BY ALL"""),
    "n12_richardson_lucy": (lambda s, d: rounded(stencils.richardson_lucy(v.grid(s, d), size=4)), None),
    "x1_spill_rows": (lambda s, d: rounded(_rows(s, d)), f"WITH {GRID}, {SPILL_ROWS} SELECT acq_id, emitter, receiver, round(coeff, 6) AS coeff, pixels FROM rows_"),
    "x2_spill_matrix": (lambda s, d: rounded(_matrix(s, d)), f"WITH {GRID}, {SPILL_ROWS}, {SPILL_MATRIX} SELECT emitter, receiver, round(coeff, 6) AS coeff FROM matrix"),
    "x3_spill_qc": (lambda s, d: rounded(spillover.spill_qc(_rows(s, d), _matrix(s, d))), f"""WITH {GRID}, {SPILL_ROWS}, {SPILL_MATRIX}, u AS (SELECT emitter AS donor, count(DISTINCT acq_id) AS n, median(pixels) AS p FROM rows_ WHERE emitter =
  receiver GROUP BY ALL) SELECT m.emitter AS donor, coalesce(any_value(n), 0) AS n_acqs, round(sum(coeff), 6) AS offdiag_sum, round(max(coeff), 6) AS
  offdiag_max, CASE WHEN max(coeff) > 0 THEN arg_max(receiver, (coeff, receiver)) END AS offdiag_max_recipient, floor(coalesce(any_value(p),
  0))::BIGINT AS pixels_used_median FROM matrix m LEFT JOIN u ON donor = emitter WHERE emitter != receiver GROUP BY m.emitter"""),
    "x4_compute_spillmat": (lambda s, d: rounded(spillover.compute_spillmat(_events(s, d), _events(s, d).select("channel"))), _spillmat_sql("default", 0.1)),
    "x4_compute_spillmat_classic": (lambda s, d: rounded(spillover.compute_spillmat(_events(s, d), _events(s, d).select("channel"), "classic", 0.1)), _spillmat_sql("classic", 0.1)),
    "x5_compensate": (lambda s, d: rounded(_compensated(s, d), 4), None),
    "x6_compensate_pixels": (lambda s, d: rounded(spillover.compensate_pixels(v.grid(s, d), _matrix(s, d), v.GRID_CHANNELS, v.mask(s, d)), 5), None),
    "x7_adapt_spillmat": (lambda s, d: rounded(spillover.adapt_spillmat(_matrix(s, d), v.grid(s, d).select("channel").union(s.createDataFrame([("ch9",)], "channel string")))), f"""WITH {GRID}, {SPILL_ROWS}, {SPILL_MATRIX}, c AS (SELECT DISTINCT channel AS c FROM grid UNION SELECT 'ch9') SELECT e.c AS emitter, r.c AS receiver,
  round(CASE WHEN e.c = r.c THEN 1 ELSE coalesce(coeff, 0) END, 6) AS coeff FROM c e CROSS JOIN c r LEFT JOIN matrix ON emitter = e.c AND receiver =
  r.c"""),
    "j12_spill_candidates": (lambda s, d: spillover.spill_candidates(_channels(s, d)), f"""WITH {CHANNEL_SQL} SELECT DISTINCT a.metal || a.mass AS emitter, b.metal || b.mass AS receiver FROM ch a JOIN ch b ON b.mass != a.mass AND (b.mass -
  a.mass IN (-1, 1, 16) OR b.mass IN (SELECT isotope FROM iso WHERE iso.metal = a.metal))"""),
    "j14_infer_donor": (
        lambda s, d: spillover.infer_donor(v.read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("acq_id"), F.col("c_custkey").alias("idx"), F.concat(F.lit("roi_"), F.element_at(F.array(F.lit("Yb174"), F.lit("nd"), F.lit("x")), (F.col("c_custkey") % 3 + 1).cast("int"))).alias("name"), F.lit("").alias("well")), s.createDataFrame([("Yb174",), ("Nd142",), ("Gd158",)], "channel string"), s.createDataFrame([("5", "Gd158")], "key string, donor string")),
        """SELECT c_custkey::VARCHAR AS acq_id, CASE WHEN c_custkey = 5 THEN 'Gd158' WHEN c_custkey % 3 = 0 THEN 'Yb174' WHEN c_custkey % 3 = 1 THEN 'Nd142' END
  AS donor FROM customer""",
    ),
    "j8_knn_features": (lambda s, d: rounded(knn_features(v.vectors(s, d), "vec_id", ALL, 6).select("vec_id", "other", "distance", "weight")), _knn_sql("euclidean")),
    "j8_knn_features_manhattan": (lambda s, d: rounded(knn_features(v.vectors(s, d), "vec_id", ALL, 6, "manhattan").select("vec_id", "other", "distance", "weight")), _knn_sql("manhattan")),
    "j8_knn_features_cosine": (lambda s, d: rounded(knn_features(v.vectors(s, d), "vec_id", ALL, 6, "cosine").select("vec_id", "other", "distance", "weight")), _knn_sql("cosine")),
    "b3_combat": (lambda s, d: rounded(batches.combat(v.vectors(s, d), "batch", ALL, ["label"]), 5), None),
    "b4_harmony": (lambda s, d: rounded(batches.harmony(v.vectors(s, d), "batch", ALL), 4), None),
    "b5_bbknn_smooth": (lambda s, d: rounded(batches.bbknn_smooth(v.vectors(s, d), "vec_id", "batch", ALL), 4), None),
    "u1_pca": (lambda s, d: rounded(clustering.pca(v.vectors(s, d), ALL, k=2)[0].select("vec_id", "pc1", "pc2"), 5), None),
    "u2_kmeans": (lambda s, d: rounded(clustering.kmeans(v.vectors(s, d), ALL, 5).select("vec_id", "cluster")), None),
    "u3_louvain": (lambda s, d: rounded(clustering.graph_cluster(v.vectors(s, d), "vec_id", ALL, "louvain").select("vec_id", "cluster")), None),
    "u4_leiden": (lambda s, d: rounded(clustering.graph_cluster(v.vectors(s, d), "vec_id", ALL, "leiden").select("vec_id", "cluster")), None),
    "u5_hierarchical": (lambda s, d: rounded(clustering.hierarchical(v.vectors(s, d), ALL, 5).select("vec_id", "cluster")), None),
    "u6_density": (lambda s, d: rounded(clustering.density_clusters(v.vectors(s, d), "vec_id", ALL).select("vec_id", "cluster")), None),
    "u7_k_search": (lambda s, d: rounded(clustering.k_search(v.vectors(s, d), ALL, 2, 5)), None),
    "u5_hierarchical_cells": (lambda s, d: rounded(clustering.hierarchical(v.vectors(s, d), ALL, 5, "average", micro=None).select("vec_id", "cluster")), None),
    "u7_k_search_hierarchical": (lambda s, d: rounded(clustering.k_search(v.vectors(s, d), ALL, 2, 5, method="hierarchical")), None),
    "u7_silhouette": (
        lambda s, d: rounded(silhouette(v.vectors(s, d), ALL, "label", noise=())),
        """WITH d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN
  embeddings b ON a.vec_id <> b.vec_id AND a.label IS NOT NULL AND b.label IS NOT NULL), m AS (SELECT vec_id, la, lb, avg(d) AS m FROM d GROUP BY ALL),
  s AS (SELECT vec_id, la, max(m) FILTER (la = lb) AS a, min(m) FILTER (la <> lb) AS b FROM m GROUP BY ALL)
  SELECT la AS label, count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS
  silhouette FROM s GROUP BY GROUPING SETS ((la), ())""",
    ),
    "u7_within_squares": (
        lambda s, d: rounded(within_squares(v.vectors(s, d), ALL, "label", noise=())),
        """WITH e AS (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL),
  s AS (SELECT label, i, count(*) AS c, count(*) * var_pop(v) AS s FROM e GROUP BY ALL) SELECT label, max(c) AS n, round(sum(s), 6) AS wcss FROM s
  GROUP BY label""",
    ),
    "g1_spatial_communities": (lambda s, d: rounded(clustering.spatial_communities(_spatial_edges(s, d))), None),
    "s5_acquisitions": (lambda s, d: io.acquisitions(v.grid(s, d)).select("acq_id", F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"), F.array_join("channels", ",").alias("channels")), f"""WITH {GRID} SELECT acq_id, (max(y) + 1)::BIGINT AS height, (max(x) + 1)::BIGINT AS width, string_agg(DISTINCT channel, ',' ORDER BY channel) AS
  channels FROM grid GROUP BY ALL"""),
    "s5_image_stack": (lambda s, d: rounded(io.image_stack(v.grid(s, d), v.GRID_CHANNELS)), f"WITH {GRID} SELECT acq_id, y::BIGINT AS y, x::BIGINT AS x, " + ", ".join(f"round(max(value) FILTER (channel = 'ch{i}'), 6) AS ch{i}" for i in range(4)) + " FROM grid GROUP BY ALL"),
    "s6_channel_names": (
        lambda s, d: rounded(io.channel_names(v.read(s, d, "part").select(F.col("p_partkey").cast("string").alias("acq_id"), F.array("p_brand", F.lit(""), F.lit(None).cast("string")).alias("channel_metals"), F.array("p_type", "p_name", F.lit(None).cast("string")).alias("channel_labels")))),
        "SELECT p_partkey::VARCHAR AS acq_id, unnest([0, 1, 2])::BIGINT AS idx, unnest([p_type || '_' || p_brand, p_name, 'Channel_2']) AS channel FROM part",
    ),
    "s7_unique_acquisition": (lambda s, d: io.with_unique_ids(v.read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("acq_id"), "c_name"), F.col("c_name")), "SELECT c_custkey::VARCHAR || '__file_' || substr(md5(c_name), 1, 8) AS acq_id, c_name FROM customer"),
    "s8_channel_mismatch": (lambda s, d: io.channel_mismatch(v.read(s, d, "part").select(F.col("p_brand").alias("source_file"), F.concat(F.lit("ch"), "p_size").alias("channel"))), """WITH o AS (SELECT DISTINCT p_brand AS source_file, 'ch' || p_size AS channel FROM part) SELECT f.source_file, c.channel FROM (SELECT DISTINCT
  source_file FROM o) f CROSS JOIN (SELECT DISTINCT channel FROM o) c EXCEPT SELECT * FROM o"""),
    "s12_clustering_output": (lambda s, d: io.clustering_output(v.cells(s, d).drop("cluster").select("roi_id", "cell_id"), v.cells(s, d).filter("status = 'F'").select("roi_id", "cell_id", "cluster")), f"WITH {CELLS} SELECT roi_id, cell_id, CASE WHEN status = 'F' THEN cluster ELSE '' END AS cluster, '' AS cluster_phenotype, '' AS manual_phenotype FROM cells"),
    "s13_acquisition_list": (lambda s, d: io.acquisition_list(v.cells(s, d).select("source_file", "roi_id", "cell_id", "cluster"), ["source_file", "roi_id"]), f"WITH {CELLS} SELECT source_file, roi_id, min(cell_id) AS cell_id, arg_min(cluster, cell_id) AS cluster FROM cells GROUP BY ALL"),
    "j3_match_masks": (
        lambda s, d: io.match_masks(v.read(s, d, "nation").select(F.concat(F.lit("mask_"), F.lower("n_name"), F.lit(".tif")).alias("mask_file")), v.read(s, d, "nation").select(F.col("n_nationkey").alias("idx"), F.concat(F.lit("id#"), "n_nationkey").alias("acq_id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("well"))),
        """SELECT 'mask_' || lower(m.n_name) || '.tif' AS mask_file, 'id#' || min(a.n_nationkey) AS acq_id FROM nation m JOIN nation a ON contains('mask_' ||
  lower(m.n_name) || '.tif', lower(a.n_name)) GROUP BY m.n_name""",
    ),
}


def _spatial_edges(s, d):
    return radius_edges(v.cells(s, d), radius_px=40.0)



