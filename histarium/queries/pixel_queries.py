"""Queries on pixels: ranges, features, quality control, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation, extraction, features, qc, scaling
from . import views as v
from .views import FLAT, GRID, MASK, rounded

LABELLED = "labelled AS (SELECT grid.*, cell_id FROM grid JOIN mask USING (acq_id, y, x) WHERE cell_id > 0)"
STATS = "round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, round(mad(value), 6) AS mad, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, round(sum(value), 6) AS integrated, round(avg((value > 0)::INT), 6) AS frac_pos"


def _wide_sql(source: str, channels: list[str]) -> str:
    stats = {"mean": "avg(value)", "median": "median(value)", "std": "stddev_pop(value)", "mad": "mad(value)", "p10": "quantile_cont(value, 0.1)", "p90": "quantile_cont(value, 0.9)", "integrated": "sum(value)", "frac_pos": "avg((value > 0)::INT)"}
    one = lambda c, s, e: f"round({'max' if s == 'frac_pos' else 'asinh(max'}(CASE WHEN channel = '{c}' THEN {s} END){'' if s == 'frac_pos' else ' / 10)'}, 6) AS {c}_{s}"
    inner = ", ".join(f"{e} AS {s}" for s, e in stats.items())
    return f"""SELECT acq_id, cell_id, {', '.join(one(c, s, e) for c in channels for s, e in stats.items())} FROM (SELECT acq_id, cell_id, channel, {inner} FROM
  {source} GROUP BY ALL) GROUP BY ALL"""


def _flat_features(spark, sf):
    return rounded(features.intensity_wide(features.intensity_long(v.flat(spark, sf)), v.CHANNELS, 10.0), 6)


def _labelled(spark, sf):
    return features.in_cells(v.grid(spark, sf), v.mask(spark, sf))


def _acquisitions(spark, sf):
    """Files and wells of the images, from the labels of their vectors."""
    size = v.grid(spark, sf).groupBy("acq_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    own = v.read(spark, sf, "embeddings").groupBy(F.expr("vec_id div 4").cast("string").alias("acq_id")).agg(F.min("label").alias("l"))
    return own.join(size, "acq_id").select("acq_id", F.concat(F.lit("roi "), "acq_id").alias("name"), F.when(F.col("l") > 1, F.concat(F.lit("W"), "l")).alias("well"), F.concat(F.lit("slide"), "l", F.lit(".ome.tif")).alias("source_file"), "height", "width")


HOT = {"ch0": {"hot": {"method": "median3"}}, "ch2": {"hot": {"method": "median3"}}}


def _whole(spark, sf, **more):
    return extraction.extract_features(v.grid(spark, sf), v.mask(spark, sf), v.GRID_CHANNELS, denoising=HOT, acquisitions=_acquisitions(spark, sf), **more)


def _whole_sql() -> str:
    """Cross medians of two channels, then all statistics, shapes of the 4 x 4 and 3 x 4 cells, and names."""
    cross = "(SELECT unnest([0, 0, 0, 1, -1]) AS dy, unnest([0, 1, -1, 0, 0]) AS dx) o"
    near = f"""SELECT g.acq_id, g.channel, g.y, g.x, median(s.value) AS value FROM grid g, {cross} JOIN grid s ON TRUE WHERE s.acq_id = g.acq_id AND s.channel =
  g.channel AND s.y = greatest(least(g.y + dy, 7), 0) AND s.x = greatest(least(g.x + dx, 7), 0) AND g.channel IN ('ch0', 'ch2') GROUP BY ALL"""
    names = "SELECT (vec_id // 4)::VARCHAR AS acq_id, min(label) AS l FROM embeddings GROUP BY ALL"
    return f"""WITH {GRID}, {MASK}, clean AS ({near} UNION ALL SELECT acq_id, channel, y, x, value FROM grid WHERE channel NOT IN ('ch0', 'ch2')),
 labelled AS (SELECT clean.*, cell_id FROM clean JOIN mask USING (acq_id, y, x) WHERE cell_id > 0), wide AS
  ({_wide_sql("labelled", v.GRID_CHANNELS)}), names AS ({names}),
 shapes AS (SELECT acq_id, cell_id, count(*)::DOUBLE AS area_um2, round(avg(x), 6) AS centroid_x, round(avg(y), 6) AS centroid_y, 1.0::DOUBLE AS
  solidity, max(x = 0 OR y = 0 OR x = 7 OR y = 7) AS touches_border FROM mask WHERE cell_id > 0 GROUP BY ALL)
SELECT wide.* REPLACE (wide.cell_id::BIGINT AS cell_id), area_um2, centroid_x, centroid_y, solidity, touches_border, 'roi ' || acq_id AS
  acquisition_name, CASE WHEN l > 1 THEN 'W' || l END AS well, 'slide' || l || '.ome.tif' AS source_file, 'slide' || l || CASE WHEN l > 1 THEN '_W'
  || l ELSE '' END AS source_well
 FROM wide JOIN shapes USING (acq_id, cell_id) JOIN names USING (acq_id)"""


OTHER_SHAPES = ["perimeter_um", "circularity", "equivalent_diameter_um", "extent", "bbox_area_um2", "major_axis_len_um", "minor_axis_len_um", "eccentricity", "aspect_ratio"]

MORPHOLOGY_SQL = f"""WITH {MASK}, m AS (SELECT acq_id, cell_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, var_pop(x)
  AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM mask WHERE cell_id > 0 GROUP BY ALL),
 l AS (SELECT *, (xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy * xy) AS l1, greatest((xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy * xy), 0) AS l2
  FROM m)
SELECT acq_id, cell_id::BIGINT AS cell_id, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y, n::DOUBLE AS area_um2, round(sqrt(4 * n / pi()),
  6) AS equivalent_diameter_um, round(n / (w * h), 6) AS extent, (w * h)::DOUBLE AS bbox_area_um2,
 round(4 * sqrt(l1), 6) AS major_axis_len_um, round(4 * sqrt(l2), 6) AS minor_axis_len_um, round(CASE WHEN l1 > 0 THEN sqrt(1 - l2 / l1) ELSE 0 END,
  6) AS eccentricity, round(4 * sqrt(l1) / greatest(4 * sqrt(l2), 1e-6), 6) AS aspect_ratio FROM l"""

OTSU = """ends AS (SELECT acq_id, channel, min(value) AS a, max(value) AS b FROM grid GROUP BY ALL),
 hist AS (SELECT acq_id, channel, a, (b - a) / 256 AS w, least(floor((value - a) / ((b - a) / 256)), 255)::INT AS bin, count(*) AS n FROM grid JOIN
  ends USING (acq_id, channel) WHERE b > a GROUP BY ALL),
 cut AS (SELECT *, a + (bin + 0.5) * w AS centre, sum(n) OVER u AS n1, sum(n * (a + (bin + 0.5) * w)) OVER u AS s1, sum(n) OVER p AS n_all, sum(n *
  (a + (bin + 0.5) * w)) OVER p AS s FROM hist WINDOW u AS (PARTITION BY acq_id, channel ORDER BY bin), p AS (PARTITION BY acq_id, channel)),
 best AS (SELECT acq_id, channel, arg_max(centre, (round(n1 * (n_all - n1) * (s1 / n1 - (s - s1) / (n_all - n1)) ** 2, 6), -bin)) AS t FROM cut WHERE
  n_all > n1 GROUP BY ALL),
 otsu AS (SELECT acq_id, channel, coalesce(t, b) AS threshold FROM ends LEFT JOIN best USING (acq_id, channel))"""

QC_PIXEL = f"""WITH {GRID}, {OTSU}, q AS (SELECT acq_id, channel, threshold, avg(value) AS im, stddev_pop(value) AS isd, median(value) AS med, min(value) AS mn,
  max(value) AS mx, count(*) AS n, avg(value) FILTER (value > threshold) AS s, stddev_pop(value) FILTER (value > threshold) AS ss, avg(value) FILTER
  (value <= threshold) AS bm, stddev_pop(value) FILTER (value <= threshold) AS bs, count(*) FILTER (value > threshold) AS f, quantile_cont(value,
  [0.01, 0.25, 0.75, 0.99]) AS qs FROM grid JOIN otsu USING (acq_id, channel) GROUP BY ALL)"""

RANKS = """r AS (SELECT acq_id, channel, y, x, rank() OVER (PARTITION BY acq_id, channel ORDER BY value) + (count(*) OVER (PARTITION BY acq_id, channel, value)
  - 1) / 2 AS v FROM grid)"""

GAP = "(channel = 'ch1' AND (x + y) % 5 = 0) OR (channel = 'ch2' AND x = 7) OR (channel = 'ch3' AND x = 7)"

QUERIES = {
    "a11_intensity_features": (lambda s, d: rounded(features.intensity_long(v.flat(s, d))), f"WITH {FLAT} SELECT acq_id, cell_id, channel, {STATS} FROM flat GROUP BY ALL"),
    "a15_features_wide_arcsinh": (_flat_features, f"WITH {FLAT} {_wide_sql('flat', v.CHANNELS)}"),
    "a1_morphology": (lambda s, d: rounded(features.morphology(v.mask(s, d))), MORPHOLOGY_SQL),
    "a7_perimeter": (
        lambda s, d: rounded(features.perimeter(v.mask(s, d))),
        f"""WITH {MASK}, c AS (SELECT * FROM mask WHERE cell_id > 0), d AS (SELECT * FROM (VALUES (0, 1, 2), (0, -1, 2), (1, 0, 2), (-1, 0, 2), (1, 1, 10), (1,
  -1, 10), (-1, 1, 10), (-1, -1, 10)) t(dy, dx, w)),
 b AS (SELECT c.* FROM c WHERE (SELECT count(*) FROM c AS o WHERE o.acq_id = c.acq_id AND o.cell_id = c.cell_id AND abs(o.y - c.y) + abs(o.x - c.x) =
  1) < 4),
 k AS (SELECT b.acq_id, b.cell_id, b.y, b.x, 1 + coalesce(sum(d.w) FILTER (o.y IS NOT NULL), 0) AS code FROM b CROSS JOIN d LEFT JOIN b AS o ON
  o.acq_id = b.acq_id AND o.cell_id = b.cell_id AND o.y = b.y + d.dy AND o.x = b.x + d.dx GROUP BY ALL),
 p AS (SELECT acq_id, cell_id, sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 +
  sqrt(2)) / 2 ELSE 0 END) AS p FROM k GROUP BY ALL), a AS (SELECT acq_id, cell_id, count(*) AS n FROM c GROUP BY ALL)
SELECT acq_id, cell_id::BIGINT AS cell_id, round(p, 6) AS perimeter_um, round(4 * pi() * n / greatest(p, 1e-6) ** 2, 6) AS circularity FROM a JOIN p
  USING (acq_id, cell_id)""",
    ),
    "a9_solidity": (lambda s, d: rounded(features.solidity(v.mask(s, d))), f"WITH {MASK} SELECT acq_id, cell_id::BIGINT AS cell_id, 1.0::DOUBLE AS solidity FROM mask WHERE cell_id > 0 GROUP BY ALL"),
    "a10_touches_border": (
        lambda s, d: rounded(features.touches_border(v.mask(s, d), v.mask(s, d).groupBy("acq_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")))),
        f"WITH {MASK} SELECT acq_id, cell_id::BIGINT AS cell_id, max(x = 0 OR y = 0 OR x = 7 OR y = 7) AS touches_border FROM mask WHERE cell_id > 0 GROUP BY ALL",
    ),
    "j1_pixels_in_cells": (lambda s, d: rounded(features.in_cells(v.grid(s, d), v.mask(s, d)).select("acq_id", "y", "x", "channel", "value", "cell_id")), f"""WITH {GRID}, {MASK} SELECT acq_id, y::BIGINT AS y, x::BIGINT AS x, channel, round(value, 6) AS value, cell_id::BIGINT AS cell_id FROM grid JOIN mask
  USING (acq_id, y, x) WHERE cell_id > 0"""),
    "j1_pixels_outside_cells": (lambda s, d: rounded(features.outside_cells(v.grid(s, d), v.mask(s, d)).select("acq_id", "y", "x", "channel", "value")), f"WITH {GRID}, {MASK} SELECT acq_id, y::BIGINT AS y, x::BIGINT AS x, channel, round(value, 6) AS value FROM grid JOIN mask USING (acq_id, y, x) WHERE cell_id = 0"),
    "a15_grid_features": (lambda s, d: rounded(extraction.extract_features(v.grid(s, d), v.mask(s, d), v.GRID_CHANNELS, shapes=False)), f"WITH {GRID}, {MASK}, {LABELLED} {_wide_sql('labelled', v.GRID_CHANNELS).replace('SELECT acq_id, cell_id,', 'SELECT acq_id, cell_id::BIGINT AS cell_id,', 1)}"),
    "a15_extract_features": (lambda s, d: rounded(_whole(s, d).drop(*OTHER_SHAPES)), _whole_sql()),
    "a15_extract_features_unmixed": (lambda s, d: rounded(_whole(s, d, spill=v.even_spill(s, v.GRID_CHANNELS), method="nnls"), 5), None),
    "p10_percentile_clip": (lambda s, d: rounded(scaling.percentile_clip(v.grid(s, d)).select("acq_id", "channel", "y", "x", "value")), f"""WITH {GRID}, q AS (SELECT acq_id, channel, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM grid GROUP BY ALL) SELECT acq_id,
  channel, y::BIGINT AS y, x::BIGINT AS x, round(CASE WHEN b > a THEN (least(greatest(value, a), b) - a) / (b - a) ELSE 0 END, 6) AS value FROM grid
  JOIN q USING (acq_id, channel)"""),
    "p11_minmax": (lambda s, d: rounded(scaling.minmax(v.grid(s, d)).select("acq_id", "channel", "y", "x", "value")), f"""WITH {GRID} SELECT acq_id, channel, y::BIGINT AS y, x::BIGINT AS x, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6)
  AS value FROM grid WINDOW w AS (PARTITION BY acq_id, channel)"""),
    "p12_robust_scale": (lambda s, d: rounded(scaling.robust_scale(v.grid(s, d), 2, 98).select("acq_id", "channel", "y", "x", "value")), f"""WITH {GRID}, q AS (SELECT acq_id, channel, quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS b FROM grid GROUP BY ALL) SELECT acq_id,
  channel, y::BIGINT AS y, x::BIGINT AS x, round((least(greatest(value, a), b) - a) / (b - a), 6) AS value FROM grid JOIN q USING (acq_id, channel)"""),
    "p13_combine_weighted": (lambda s, d: rounded(scaling.combine_channels(v.grid(s, d), "weighted", {"ch0": 1.0, "ch1": 2.0})), f"""WITH {GRID} SELECT acq_id, y::BIGINT AS y, x::BIGINT AS x, round(sum(value * CASE channel WHEN 'ch0' THEN 1 / (3 + 1e-8) WHEN 'ch1' THEN 2 / (3 +
  1e-8) ELSE 0 END), 6) AS value FROM grid GROUP BY ALL"""),
    "p13_combine_max": (lambda s, d: rounded(scaling.combine_channels(v.grid(s, d), "max")), f"WITH {GRID} SELECT acq_id, y::BIGINT AS y, x::BIGINT AS x, round(max(value), 6) AS value FROM grid GROUP BY ALL"),
    "p13_combine_pca1": (lambda s, d: rounded(scaling.combine_channels(v.grid(s, d), "pca1")), None),
    "p14_auto_range_linked": (lambda s, d: rounded(scaling.auto_range(v.flat(s, d), linked=True, contrast=True).drop("acq_id")), f"WITH {FLAT} SELECT channel, round(quantile_cont(value, 0.01), 6) AS lo, round(quantile_cont(value, 0.99), 6) AS hi FROM flat GROUP BY ALL"),
    "p14_auto_range": (lambda s, d: rounded(scaling.auto_range(v.flat(s, d))), f"WITH {FLAT} SELECT acq_id, channel, min(value) AS lo, max(value) AS hi FROM flat GROUP BY ALL"),
    "n9_otsu": (lambda s, d: rounded(qc.otsu(v.grid(s, d))), f"WITH {GRID}, {OTSU} SELECT acq_id, channel, round(threshold, 6) AS threshold FROM otsu"),
    "q1_qc_pixel": (
        lambda s, d: rounded(qc.qc_pixel(v.grid(s, d)), 5),
        QC_PIXEL + """ SELECT acq_id, channel, round(threshold, 5) AS threshold, round((s - bm) / greatest(bs, abs(bm) * 0.001, 1e-6, (mx - mn) * 0.0001), 5) AS snr,
  round((s - bm) / bs, 5) AS snr_plain, round(s, 5) AS signal_mean, round(ss, 5) AS signal_std, round(bm, 5) AS background_mean, round(bs, 5) AS
  background_std, round(im, 5) AS intensity_mean, round(isd, 5) AS intensity_std, round(med, 5) AS intensity_median, round(mn, 5) AS intensity_min,
  round(mx, 5) AS intensity_max, round(f / n, 5) AS coverage, round(f / n * 100, 5) AS coverage_pct, n AS total_pixels, f AS foreground_pixels,
  round(qs[1], 5) AS p1, round(qs[2], 5) AS p25, round(qs[3], 5) AS p75, round(qs[4], 5) AS p99 FROM q""",
    ),
    "q2_qc_cell": (
        lambda s, d: rounded(qc.qc_cell(v.grid(s, d), v.mask(s, d)), 5),
        f"""WITH {GRID}, {MASK}, {LABELLED}, c AS (SELECT acq_id, channel, cell_id, avg(value) AS m, count(*) AS n FROM labelled GROUP BY ALL), sg AS (SELECT
  acq_id, channel, avg(m) AS s, stddev_pop(m) AS ss, median(m) AS cm, count(*) AS k, sum(n) AS cp FROM c GROUP BY ALL),
 bg AS (SELECT acq_id, channel, avg(value) AS bm, stddev_pop(value) AS bs FROM grid JOIN mask USING (acq_id, y, x) WHERE cell_id = 0 GROUP BY ALL), o
  AS (SELECT acq_id, channel, avg(value) AS im, stddev_pop(value) AS isd, median(value) AS med, min(value) AS mn, max(value) AS mx, count(*) AS n
  FROM grid GROUP BY ALL)
SELECT acq_id, channel, round((s - bm) / greatest(bs, abs(bm) * 0.001, 1e-6, (mx - mn) * 0.0001), 5) AS snr, round(s, 5) AS signal_mean, round(ss, 5)
  AS signal_std, round(cm, 5) AS cell_median, round(bm, 5) AS background_mean, round(bs, 5) AS background_std, round(im, 5) AS intensity_mean,
  round(isd, 5) AS intensity_std, round(med, 5) AS intensity_median, round(mn, 5) AS intensity_min, round(mx, 5) AS intensity_max, round(cp / n, 5)
  AS coverage, round(cp / n * 100, 5) AS coverage_pct, round(k / n, 5) AS cell_density, k AS n_cells FROM o JOIN sg USING (acq_id, channel) JOIN bg
  USING (acq_id, channel)""",
    ),
    "q5_qc_by_channel": (lambda s, d: rounded(qc.qc_by_channel(qc.qc_pixel(v.grid(s, d)), ["snr", "coverage", "intensity_mean"]), 5), QC_PIXEL + """ SELECT channel, round(avg((s - bm) / greatest(bs, abs(bm) * 0.001, 1e-6, (mx - mn) * 0.0001)), 5) AS snr, round(avg(f / n), 5) AS coverage,
  round(avg(im), 5) AS intensity_mean, count(DISTINCT acq_id) AS n_rois FROM q GROUP BY ALL"""),
    "q6_low_variance_channels": (lambda s, d: rounded(qc.low_variance_channels(v.flat(s, d).groupBy("cell_id", "channel").agg(F.avg("value").alias("mean")))), f"""WITH {FLAT}, c AS (SELECT channel, stddev_pop(m) / (avg(m) + 1e-8) AS cv FROM (SELECT cell_id, channel, avg(value) AS m FROM flat GROUP BY ALL) GROUP
  BY ALL) SELECT channel, round(cv, 6) AS cv, row_number() OVER (ORDER BY cv, channel) <= greatest(1, floor(count(*) OVER () * 0.2)) AS suggested
  FROM c"""),
    "q7_pixel_correlation": (lambda s, d: rounded(correlation.pixel_correlation(v.grid(s, d)).drop("p")), f"""WITH {GRID}, {RANKS} SELECT a.acq_id, a.channel AS channel_a, b.channel AS channel_b, round(corr(a.v, b.v), 6) AS r, count(*) AS n FROM r a JOIN r b
  USING (acq_id, y, x) WHERE a.channel < b.channel GROUP BY ALL"""),
    "q7_pixel_correlation_p": (lambda s, d: rounded(correlation.adjust_p(correlation.pixel_correlation(v.grid(s, d), v.mask(s, d), complete=True), "fdr_bh", ["acq_id"])), None),
    "q7_pixel_correlation_gaps": (
        lambda s, d: rounded(correlation.pixel_correlation(v.grid(s, d).withColumn("value", F.when(F.expr(GAP), F.lit(float("nan"))).otherwise(F.col("value")))).drop("p")),
        f"""WITH {GRID}, g AS (SELECT * FROM grid WHERE NOT ({GAP})), p AS (SELECT a.acq_id, a.channel AS channel_a, b.channel AS channel_b, a.value AS va, b.value AS vb
  FROM g a JOIN g b USING (acq_id, y, x) WHERE a.channel < b.channel), k AS (SELECT acq_id, channel_a, channel_b,
  rank() OVER (PARTITION BY acq_id, channel_a, channel_b ORDER BY va) + (count(*) OVER (PARTITION BY acq_id, channel_a, channel_b, va) - 1) / 2 AS ra,
  rank() OVER (PARTITION BY acq_id, channel_a, channel_b ORDER BY vb) + (count(*) OVER (PARTITION BY acq_id, channel_a, channel_b, vb) - 1) / 2 AS rb FROM p)
  SELECT acq_id, channel_a, channel_b, round(corr(ra, rb), 6) AS r, count(*) AS n FROM k GROUP BY ALL HAVING count(*) >= 3""",
    ),
    "q10_correlation_matrix": (
        lambda s, d: rounded(correlation.correlation_matrix(correlation.pixel_correlation(v.grid(s, d), complete=True).groupBy("channel_a", "channel_b").agg(F.avg("r").alias("r")), v.GRID_CHANNELS)),
        f"""WITH {GRID}, {RANKS}, c AS (SELECT ca, cb, avg(r) AS r FROM (SELECT a.acq_id, a.channel AS ca, b.channel AS cb, corr(a.v, b.v) AS r FROM r a JOIN r b
  USING (acq_id, y, x) GROUP BY ALL) GROUP BY ALL) SELECT ca AS channel, """ + ", ".join(f"round(max(r) FILTER (cb = 'ch{i}'), 6) AS ch{i}" for i in range(4)) + " FROM c GROUP BY ALL",
    ),
    "q11_qc_points": (lambda s, d: rounded(qc.qc_points(qc.qc_pixel(v.grid(s, d))), 5), QC_PIXEL + """, z AS (SELECT acq_id, channel, (s - bm) / greatest(bs, abs(bm) * 0.001, 1e-6, (mx - mn) * 0.0001) AS snr, im FROM q) SELECT acq_id, channel,
  round(log10(snr), 5) AS log_snr, round(log10(im), 5) AS log_intensity FROM z WHERE snr > 0 AND im > 0"""),
    "q11_qc_distributions": (
        lambda s, d: rounded(qc.qc_distributions(qc.qc_pixel(v.grid(s, d))), 5),
        QC_PIXEL + ", z AS (SELECT channel, (s - bm) / greatest(bs, abs(bm) * 0.001, 1e-6, (mx - mn) * 0.0001) AS snr, im, f / n AS cov FROM q) SELECT channel, " + ", ".join(f"round(coalesce(quantile_cont({e}, {p / 100}) {w}, 0), 5) AS {n}_q{p}" for n, e, w in (("snr", "snr", "FILTER (snr > 0)"), ("intensity", "im", "FILTER (im > 0)"), ("coverage", "cov", "")) for p in (25, 50, 75)) + " FROM z GROUP BY ALL",
    ),
}
