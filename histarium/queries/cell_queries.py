"""Queries on cells: imputation, scaling, gates, cluster statistics, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import correlation, gates, scaling, statistics
from . import views as v
from .views import CELLS, rounded

RULES = [
    {"name": "big", "logic": "AND", "conditions": [{"column": "quantity_mean", "op": ">", "threshold": 30.0}, {"column": "price_mean", "op": ">=", "threshold": 50000.0}]},
    {"name": "cheap", "logic": "OR", "conditions": [{"column": "price_mean", "op": "<", "threshold": 30000.0}, {"column": "nope", "op": "<", "threshold": 1.0}, {"column": "tax_mean", "op": "<=", "threshold": 0.01}]},
    {"name": "void", "logic": "AND", "conditions": [{"column": "nope", "op": ">", "threshold": 0.0}]},
]
GATE_SQL = "CASE WHEN coalesce(quantity_mean > 30, FALSE) AND coalesce(price_mean >= 50000, FALSE) THEN 'big' WHEN coalesce(price_mean < 30000, FALSE) OR coalesce(tax_mean <= 0.01, FALSE) THEN 'cheap' ELSE '' END"
M = v.MARKERS


def _zscored(s, d):
    return scaling.scale_zscore(scaling.impute_median(v.cells(s, d), M), M).select("roi_id", "cell_id", *M)


def _mad_scaled(s, d):
    return scaling.scale_mad(scaling.impute_median(v.cells(s, d), M), M).select("roi_id", "cell_id", *M)


IMPUTED = "imputed AS (SELECT roi_id, cell_id, cluster, " + ", ".join(f"coalesce({m}, median({m}) OVER ()) AS {m}" for m in M) + " FROM cells)"
LONG = "long AS (SELECT cluster, status, roi_id, cell_id, unnest([" + ", ".join(f"'{m}'" for m in M) + "]) AS feature, unnest([" + ", ".join(M) + "]) AS value FROM cells)"
MEANS = f"""means AS (SELECT cluster, feature, avg(value) AS mean FROM long GROUP BY ALL), z AS (SELECT *, (mean - avg(mean) OVER w) / CASE WHEN
  stddev_samp(mean) OVER w > 0 THEN stddev_samp(mean) OVER w ELSE 1 END AS z FROM means WINDOW w AS (PARTITION BY feature))"""
MARKERS_SQL = f"""WITH {CELLS}, {LONG}, v AS (SELECT * FROM long WHERE value IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) +
  (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rk FROM v),
 g AS (SELECT cluster, feature, avg(value) AS mean, median(value) AS med, min(value) AS mn, max(value) AS mx, count(*) AS n, count(*) FILTER (value >
  0) AS pos, sum(rk) AS ranks FROM r GROUP BY ALL),
 h AS (SELECT *, sum(n) OVER w AS na, sum(pos) OVER w AS pa, count(*) OVER w AS k, avg(mean) OVER w AS am, stddev_samp(mean) OVER w AS sd, (sum(mean)
  OVER w - mean) / (count(*) OVER w - 1) AS rest FROM g WINDOW w AS (PARTITION BY feature))
SELECT cluster, feature, regexp_replace(feature, '_[^_]*$', '') AS marker, round(mean, 5) AS mean, round(med, 5) AS median, round(mn, 5) AS min,
  round(mx, 5) AS max, round(mx - mn, 5) AS range, n, round((mean - am) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 5) AS z, round(log2((mean + 1e-6) /
  (rest + 1e-6)), 5) AS log2_fold_change, round((ranks - n * (n + 1) / 2) / (n * (na - n)), 5) AS auroc, round(pos / n, 5) AS pct_in, round((pa -
  pos) / (na - n), 5) AS pct_out FROM h"""
U_SQL = f"""WITH {CELLS}, {LONG}, v AS (SELECT feature, cluster AS g, value FROM long WHERE value IS NOT NULL), s AS (SELECT feature, g, count(*) AS n FROM v
  GROUP BY ALL HAVING count(*) >= 2), p AS (SELECT a.feature, a.g AS ga, a.n AS na, b.g AS gb, b.n AS nb FROM s a JOIN s b ON a.feature = b.feature
  AND a.g < b.g),
 x AS (SELECT p.*, v.g, v.value FROM p JOIN v ON v.feature = p.feature AND v.g IN (p.ga, p.gb)), r AS (SELECT *, rank() OVER (PARTITION BY feature,
  ga, gb ORDER BY value) + (count(*) OVER (PARTITION BY feature, ga, gb, value) - 1) / 2 AS rk FROM x)
SELECT feature, ga AS group_a, gb AS group_b, na AS n_a, nb AS n_b, round(sum(rk) FILTER (g = ga) - na * (na + 1) / 2, 3) AS u FROM r GROUP BY
  feature, ga, gb, na, nb"""


def _by_condition(s, d):
    """Correlation of two markers in each region, by status as the condition."""
    pairs = [(a, b) for i, a in enumerate(M) for b in M[i + 1 :]]
    held = v.cells(s, d).groupBy("roi_id", F.col("status").alias("condition")).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs], F.count("price_mean").alias("n"))
    long = held.unpivot(["roi_id", "condition", "n"], [f"{a}|{b}" for a, b in pairs], "pair", "r").filter("r is not null")
    return long.select("roi_id", "condition", "n", F.split("pair", "\\|")[0].alias("channel_a"), F.split("pair", "\\|")[1].alias("channel_b"), "r", (1 - F.abs("r")).alias("p"))


CONDITION_SQL = f"""WITH {CELLS}, c AS (SELECT roi_id, status AS condition, count(price_mean) AS n,
  {", ".join(f"corr({a}, {b}) AS p{i}{j}" for i, a in enumerate(M) for j, b in enumerate(M) if i < j)} FROM cells GROUP BY ALL),
 l AS
  ({" UNION ALL ".join(f"SELECT roi_id, condition, n, '{a}' AS channel_a, '{b}' AS channel_b, p{i}{j} AS r FROM c" for i, a in enumerate(M) for j, b in enumerate(M) if i < j)}),
 g AS (SELECT condition, channel_a, channel_b, grouping(condition) AS overall, avg(r) AS r, avg(1 - abs(r)) AS p, sum(n) AS n, count(*) AS n_rois
  FROM l WHERE r IS NOT NULL GROUP BY GROUPING SETS ((condition, channel_a, channel_b), (channel_a, channel_b))),
 q AS (SELECT *, p * count(*) OVER (PARTITION BY overall, condition) / row_number() OVER (PARTITION BY overall, condition ORDER BY p) AS raw FROM g)
SELECT condition, channel_a, channel_b, overall::BIGINT AS overall, round(r, 6) AS r, round(p, 6) AS p, n::BIGINT AS n, n_rois, round(least(min(raw)
  OVER (PARTITION BY overall, condition ORDER BY p DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS p_adjusted FROM q"""

QUERIES = {
    "p5_impute_median": (lambda s, d: rounded(scaling.impute_median(v.cells(s, d), M).select("roi_id", "cell_id", *M)), f"WITH {CELLS}, {IMPUTED} SELECT roi_id, cell_id, {', '.join(f'round({m}, 6) AS {m}' for m in M)} FROM imputed"),
    "p6_drop_nonfinite": (lambda s, d: rounded(scaling.drop_nonfinite(v.cells(s, d), M).select("roi_id", "cell_id", *M)), f"WITH {CELLS} SELECT roi_id, cell_id, {', '.join(f'round({m}, 6) AS {m}' for m in M)} FROM cells WHERE price_mean IS NOT NULL"),
    "p7_scale_zscore": (lambda s, d: rounded(_zscored(s, d)), f"WITH {CELLS}, {IMPUTED} SELECT roi_id, cell_id, {', '.join(f'round(({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER (), 6) AS {m}' for m in M)} FROM imputed"),
    "p8_scale_mad": (lambda s, d: rounded(_mad_scaled(s, d)), f"""WITH {CELLS}, {IMPUTED}, k AS (SELECT {', '.join(f'median({m}) AS m{i}, mad({m}) AS d{i}' for i, m in enumerate(M))} FROM imputed) SELECT roi_id,
  cell_id, {', '.join(f'round(CASE WHEN d{i} > 0 THEN ({m} - m{i}) / d{i} ELSE 0 END, 6) AS {m}' for i, m in enumerate(M))} FROM imputed, k"""),
    "p9_arcsinh": (lambda s, d: rounded(v.cells(s, d).select("cell_id", *[scalar.arcsinh(F.col(m), 5.0).alias(m) for m in M])), f"WITH {CELLS} SELECT cell_id, {', '.join(f'round(asinh({m} / 5), 6) AS {m}' for m in M)} FROM cells"),
    "p15_apply_gates": (lambda s, d: gates.apply_gates(v.cells(s, d), RULES).select("roi_id", "cell_id", "manual_phenotype"), f"WITH {CELLS} SELECT roi_id, cell_id, {GATE_SQL} AS manual_phenotype FROM cells"),
    "p16_gate_groups": (lambda s, d: gates.gate_groups(gates.apply_gates(v.cells(s, d), RULES)).groupBy("gate_group").agg(F.count("*").alias("n")), f"WITH {CELLS} SELECT coalesce(nullif({GATE_SQL}, ''), 'Unassigned') AS gate_group, count(*) AS n FROM cells GROUP BY ALL"),
    "p3_filter_sources_and_roi": (lambda s, d: gates.filter_roi(gates.filter_sources(v.cells(s, d), ["file0", "file2"]), "7", ["roi_id", "status"]).select("roi_id", "cell_id", "source_file"), f"WITH {CELLS} SELECT roi_id, cell_id, source_file FROM cells WHERE source_file IN ('file0', 'file2') AND '7' IN (roi_id, status)"),
    "p4_exclude_channels": (lambda s, d: gates.exclude_channels(v.flat(s, d), ["tax", "discount"]).groupBy("channel").agg(F.count("*").alias("n")), f"WITH {v.FLAT} SELECT channel, count(*) AS n FROM flat WHERE channel NOT IN ('tax', 'discount') GROUP BY ALL"),
    "p17_assign_groups": (
        lambda s, d: gates.assign_groups(v.cells(s, d).withColumn("source_well", F.concat_ws("_", "source_file", "status")), s.createDataFrame([("file0_F", "A"), ("file1_F", "A"), ("file2_O", "B"), ("gone", "C")], "key string, batch_group string")).groupBy("batch_group").agg(F.count("*").alias("n")),
        f"""WITH {CELLS} SELECT CASE source_file || '_' || status WHEN 'file0_F' THEN 'A' WHEN 'file1_F' THEN 'A' WHEN 'file2_O' THEN 'B' ELSE '__unassigned__'
  END AS batch_group, count(*) AS n FROM cells GROUP BY ALL""",
    ),
    "p18_source_well": (lambda s, d: v.read(s, d, "customer").select("c_custkey", scalar.source_well(F.concat(F.col("c_name"), F.element_at(F.array(F.lit(".ome.tif"), F.lit(".tif"), F.lit(".mcd"), F.lit(".csv")), (F.col("c_custkey") % 4 + 1).cast("int"))), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("")).alias("source_well")), """SELECT c_custkey, c_name || CASE WHEN c_custkey % 4 = 3 THEN '.csv' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN '_' || c_mktsegment ELSE '' END
  AS source_well FROM customer"""),
    "p19_parse_isotope": (lambda s, d: v.rounded(v.read(s, d, "part").select("p_partkey", scalar.isotope_metal(_channel()).alias("metal"), scalar.isotope_mass(_channel()).alias("mass"))), """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Ir' WHEN 1 THEN 'Yb' WHEN 2 THEN 'Nd' END AS metal, CASE p_partkey % 4 WHEN 0 THEN 191 WHEN 1 THEN
  100 + p_partkey % 90 WHEN 2 THEN 143 END::BIGINT AS mass FROM part"""),
    "p20_marker_name": (lambda s, d: v.read(s, d, "part").select("p_partkey", scalar.marker_name(F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit("PD1")).otherwise(F.col("p_type")), F.lit("_mean"))).alias("marker")), "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'PDCD1' ELSE p_type END AS marker FROM part"),
    "p21_pixel_size": (lambda s, d: v.read(s, d, "events").select("event_id", scalar.pixel_size(F.create_map(F.when(F.col("event_id") % 2 == 0, F.lit("pixel_size")).otherwise(F.lit("PhysicalSizeX")), F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")))).alias("pixel_size")), "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 1.0 ELSE value END::DOUBLE AS pixel_size FROM events"),
    "p22_stars": (lambda s, d: v.read(s, d, "lineitem").select(scalar.stars(F.col("l_discount") / 2).alias("stars")).groupBy("stars").agg(F.count("*").alias("n")), """SELECT CASE WHEN l_discount / 2 < 0.001 THEN '***' WHEN l_discount / 2 < 0.01 THEN '**' WHEN l_discount / 2 < 0.05 THEN '*' ELSE 'ns' END AS stars,
  count(*) AS n FROM lineitem GROUP BY ALL"""),
    "p23_to_um": (lambda s, d: rounded(v.cells(s, d).select("roi_id", "cell_id", scalar.to_um(F.col("x"), 0.5).alias("x_um"), scalar.to_um(F.col("y"), 0.5).alias("y_um"))), f"WITH {CELLS} SELECT roi_id, cell_id, round(x * 0.5, 6) AS x_um, round(y * 0.5, 6) AS y_um FROM cells"),
    "p24_composition_key": (lambda s, d: v.cells(s, d).select(scalar.composition_key(F.col("source_file"), F.col("roi_id")).alias("key")).groupBy("key").agg(F.count("*").alias("n")), f"WITH {CELLS} SELECT source_file || '_' || roi_id AS key, count(*) AS n FROM cells GROUP BY ALL"),
    "u8_cluster_means": (lambda s, d: rounded(statistics.cluster_means(v.cells(s, d), M)), f"WITH {CELLS} SELECT cluster, {', '.join(f'round(avg({m}), 6) AS {m}' for m in M)} FROM cells GROUP BY ALL"),
    "u8_cluster_means_zscored": (lambda s, d: rounded(statistics.cluster_means(v.cells(s, d), M, only=["1-URGENT", "5-LOW"], scale="zscore")), f"""WITH {CELLS}, k AS (SELECT * FROM cells WHERE cluster IN ('1-URGENT', '5-LOW')), a AS (SELECT
  {', '.join(f'avg({m}) AS a{i}, stddev_pop({m}) AS s{i}' for i, m in enumerate(M))} FROM k) SELECT cluster,
  {', '.join(f'round(avg(CASE WHEN {m} IS NULL THEN NULL ELSE ({m} - a{i}) / s{i} END), 6) AS {m}' for i, m in enumerate(M))} FROM k, a GROUP BY ALL"""),
    "u9_differential": (lambda s, d: rounded(statistics.differential(v.cells(s, d), M, top_n=2)), f"""WITH {CELLS}, {LONG}, {MEANS}, p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(z, 9) DESC, feature) AS place FROM z) SELECT
  cluster, feature, round(mean, 6) AS mean, round(z, 6) AS z, place FROM p WHERE place <= 2"""),
    "u10_marker_stats": (lambda s, d: rounded(statistics.marker_stats(v.cells(s, d), M), 5), MARKERS_SQL),
    "u11_mann_whitney": (lambda s, d: rounded(statistics.mann_whitney(v.cells(s, d), M, "cluster").select("feature", "group_a", "group_b", "n_a", "n_b", "u"), 3), U_SQL),
    "u11_mann_whitney_p": (lambda s, d: rounded(statistics.mann_whitney(v.cells(s, d), M, "cluster", "one_vs_rest", "5-LOW")), None),
    "u12_composition": (lambda s, d: rounded(statistics.composition(v.cells(s, d), ["source_file", "roi_id"])), f"""WITH {CELLS}, g AS (SELECT DISTINCT source_file, roi_id FROM cells), k AS (SELECT DISTINCT cluster FROM cells), n AS (SELECT source_file, roi_id,
  cluster, count(*) AS n FROM cells GROUP BY ALL) SELECT source_file, roi_id, cluster, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n,
  0)) OVER (PARTITION BY source_file, roi_id), 6) AS share FROM g CROSS JOIN k LEFT JOIN n USING (source_file, roi_id, cluster)"""),
    "u13_five_numbers": (lambda s, d: rounded(statistics.five_numbers(v.cells(s, d), M)), f"""WITH {CELLS}, {LONG} SELECT cluster, feature, count(value) AS n, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25,
  round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max FROM long GROUP BY ALL"""),
    "u14_annotate": (lambda s, d: statistics.annotate(v.cells(s, d), {"1-URGENT": "T cell", "2-HIGH": "B cell"}).groupBy("cluster_phenotype").agg(F.count("*").alias("n")), f"WITH {CELLS} SELECT CASE cluster WHEN '1-URGENT' THEN 'T cell' WHEN '2-HIGH' THEN 'B cell' ELSE '' END AS cluster_phenotype, count(*) AS n FROM cells GROUP BY ALL"),
    "u15_cluster_members": (lambda s, d: rounded(statistics.cluster_members(v.cells(s, d), ["roi_id", "cell_id"])), f"""WITH {CELLS}, p AS (SELECT cluster, roi_id, cell_id, row_number() OVER (PARTITION BY cluster ORDER BY roi_id, cell_id) AS place, count(*) OVER
  (PARTITION BY cluster) AS size FROM cells) SELECT * FROM p WHERE place <= 10"""),
    "u16_phenotype_payload": (
        lambda s, d: rounded(_payload(s, d), 3),
        MARKERS_SQL.replace("SELECT cluster, feature, regexp_replace", ", m AS (SELECT cluster, feature, regexp_replace") + ") SELECT cluster, max(n) OVER (PARTITION BY cluster) AS n_cells, marker, round(z, 3) AS z, round(auroc, 3) AS auroc, round(pct_in, 3) AS pct_in, TRUE AS valid FROM m",
    ),
    "q8_adjust_p_by": (lambda s, d: rounded(correlation.adjust_p(_tests(s, d), "fdr_by", ["brand"])), """WITH t AS (SELECT p_brand AS brand, p_partkey AS k, p_partkey * 7919 % 10007 / 10007 AS p FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY
  brand ORDER BY p) AS i, count(*) OVER (PARTITION BY brand) AS n FROM t), q AS (SELECT *, p * n * list_sum(list_transform(range(1, n + 1), lambda j:
  1 / j)) / i AS raw FROM r) SELECT brand, k, round(p, 6) AS p, round(least(min(raw) OVER (PARTITION BY brand ORDER BY i DESC ROWS UNBOUNDED
  PRECEDING), 1), 6) AS p_adjusted FROM q"""),
    "q8_adjust_p_bonferroni": (lambda s, d: rounded(correlation.adjust_p(_tests(s, d), "bonferroni", ["brand"])), """SELECT p_brand AS brand, p_partkey AS k, round(p_partkey * 7919 % 10007 / 10007, 6) AS p, round(least(p_partkey * 7919 % 10007 / 10007 * count(*)
  OVER (PARTITION BY p_brand), 1), 6) AS p_adjusted FROM part"""),
    "q9_correlation_by_condition": (lambda s, d: rounded(correlation.correlation_by_condition(_by_condition(s, d))), CONDITION_SQL),
    "j11_write_back": (lambda s, d: gates.write_back(v.cells(s, d).drop("cluster"), v.cells(s, d).filter("status = 'F'").select("roi_id", "cell_id", "cluster"), default="").groupBy("cluster").agg(F.count("*").alias("n")), f"WITH {CELLS} SELECT CASE WHEN status = 'F' THEN cluster ELSE '' END AS cluster, count(*) AS n FROM cells GROUP BY ALL"),
}


def _payload(s, d):
    """The payloads, read again as an annotator would, and its replies checked."""
    sent = statistics.phenotype_payload(statistics.marker_stats(v.cells(s, d), M))
    reply = F.to_json(F.struct(F.get_json_object("payload", "$.cluster").alias("cluster"), F.lit("x").alias("phenotype")))
    told = statistics.phenotype_reply(sent.select("payload", reply.alias("reply")))
    parsed = F.from_json("payload", "cluster string, n_cells long, markers array<struct<marker: string, z: double, auroc: double, pct_in: double>>")
    held = told.select(parsed.alias("p"), "valid").select("p.cluster", "p.n_cells", F.explode("p.markers").alias("m"), "valid")
    return held.select("cluster", "n_cells", "m.*", "valid")


def _channel():
    return F.element_at(F.array(F.lit("DNA1_Ir191"), F.concat(F.lit("Yb"), (F.col("p_partkey") % 90 + 100).cast("string"), F.lit("Di")), F.lit("143Nd"), F.lit("no isotope")), (F.col("p_partkey") % 4 + 1).cast("int"))


def _tests(s, d):
    return v.read(s, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("k"), (F.col("p_partkey") * 7919 % 10007 / 10007).alias("p"))
