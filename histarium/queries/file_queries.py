"""Queries that write and read tables, and that choose columns, channels and batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns
from ..functions.lineage import delete_at_end, shared_dir
from ..operators import batches, scaling, spillover
from ..sources import io
from . import views as v
from .views import CELLS, rounded

NUMBERS = [*v.MARKERS, "area_um2"]


def _place(spark, name: str) -> str:
    """A new path in the folder that driver and executors share, until the application ends."""
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    delete_at_end(spark, folder)
    return f"{folder}/{name}"


def _cells(spark, sf):
    return v.cells(spark, sf).select("roi_id", "cell_id", "cluster", *NUMBERS)


def _read_features(spark, sf):
    path = _place(spark, "cells.csv")
    io.write_table(_cells(spark, sf).withColumn("source_file", F.lit("cells.csv")), path)
    return io.read_features(spark, path).select(F.col("roi_id").cast("string").alias("roi_id"), "cell_id", "cluster", *[F.col(c).cast("double").alias(c) for c in NUMBERS], "source_file")


def _read_many(spark, sf):
    """Two files, of which each has a column that the other lacks."""
    one, two = _place(spark, "one"), _place(spark, "two")
    cells = v.cells(spark, sf)
    io.write_table(cells.filter("status = 'F'").select("cell_id", "roi_id", "price_mean", F.lit("one").alias("source_file")), one)
    io.write_table(cells.filter("status != 'F'").select("cell_id", "roi_id", "tax_mean", F.lit("two").alias("source_file")), two)
    return io.read_many(spark, [one, two]).groupBy("source_file", "roi_id").agg(F.count("*").alias("n"), F.count("price_mean").alias("prices"), F.count("tax_mean").alias("taxes"))


def _read_edges(spark, sf):
    path = _place(spark, "edges.csv")
    orders = v.read(spark, sf, "orders").select(F.col("o_orderstatus").alias("roi_id"), F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_totalprice").alias("distance"))
    io.write_table(orders.withColumn("distance_um", F.col("distance") / 2), path)
    return io.read_edges(spark, path)


def _read_matrix(spark, sf):
    """Mean prices of orders by priority on the diagonal of a square CSV, and back."""
    square = v.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderpriority", v.CLUSTERS).agg(F.avg("o_totalprice"))
    path = _place(spark, "matrix.csv")
    io.write_table(square.fillna(0.0), path)
    return io.read_spill_matrix(spark, path)


def _write_table(spark, sf):
    path = _place(spark, "all")
    io.write_table(_cells(spark, sf), io.companion(path, "_qc"))
    return io.read_table(spark, path + "_qc")


def _by_roi(spark, sf):
    path = _place(spark, "rois")
    cells = _cells(spark, sf)
    io.write_by_roi(cells, cells.select("roi_id", F.col("cell_id").alias("src"), (F.col("cell_id") + 1).alias("dst")), path)
    own = io.read_table(spark, f"{path}/cells").groupBy(F.col("roi_id").cast("string").alias("roi_id")).agg(F.count("*").alias("cells"), F.sum("area_um2").alias("area"))
    return own.join(io.read_table(spark, f"{path}/edges").groupBy(F.col("roi_id").cast("string").alias("roi_id")).agg(F.count("*").alias("edges")), "roi_id")


def _run_log(spark, sf):
    """An entry for each region of the world, with its nations as acquisitions."""
    path = _place(spark, "log")
    nations = v.read(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names")).orderBy("n_regionkey").collect()  # 5 rows
    for r in nations:
        io.append_run_log(spark, path, "cluster", f"region {r.n_regionkey}", {"k": len(r.names)}, r.names)
    return io.read_run_log(spark, path).select("type", "operation", F.col("parameters")["k"].alias("k"), F.array_join("acquisitions", ",").alias("acquisitions"))


def _chosen(spark, sf):
    cells = v.cells(spark, sf)
    parts = []
    for mode in ("all", "suffix", "numeric"):
        names = columns.feature_columns(cells, mode, include_centroids=False)
        parts.append(scaling.melted(cells, names, []).groupBy(F.lit(mode).alias("mode"), "feature").agg(F.avg("value").alias("mean")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _chosen_sql() -> str:
    every = [("all", ["x", "y", *NUMBERS]), ("suffix", NUMBERS), ("numeric", ["cell_id", "x", "y", *NUMBERS])]
    return f"WITH {CELLS} " + " UNION ALL ".join(f"SELECT '{mode}' AS mode, '{c}' AS feature, round(avg({c}), 6) AS mean FROM cells" for mode, names in every for c in names)


def _classified(spark, sf):
    cells = v.cells(spark, sf)
    roles = columns.classify_columns(cells)
    held = [scaling.melted(cells, names, []).groupBy(F.lit(role).alias("role"), "feature").agg(F.max("value").alias("max")) for role, names in roles.items() if names and role not in ("ids", "other")]
    return held[0].unionByName(held[1])


def _aligned(spark, sf, strict: bool):
    """Means of the cells' columns that a matrix has, under the matrix' names."""
    names = dict(zip(v.MARKERS, ["q", "p", "d", "t"], strict=True))
    pairs = spillover.align_channels(list(names), v.even_spill(spark, ["q", "p", "d", "t"] if strict else ["q", "t", "other"]), names, strict)
    cells = v.cells(spark, sf).select(*[F.col(f).alias(c) for f, c in pairs])
    return scaling.melted(cells, [c for _, c in pairs], []).groupBy("feature").agg(F.avg("value").alias("mean"))


def _aligned_sql(names: dict[str, str]) -> str:
    return f"WITH {CELLS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({f}), 6) AS mean FROM cells" for f, c in names.items())


def _batches(spark, sf):
    cells = v.cells(spark, sf)
    batch = batches.detect_batch(cells)
    batches.validate_batch(cells, batch, v.MARKERS)
    return cells.groupBy(F.lit(batch).alias("batch"), F.col(batch).alias("value")).agg(F.count("*").alias("n"))


def _usable(spark, sf):
    cells = v.cells(spark, sf).withColumn("flat", F.lit(3.0)).withColumn("zero", F.when(F.col("quantity_mean") > 49.9, 1.0).otherwise(0.0))
    names = batches.usable_features(cells, [*v.MARKERS, "flat", "zero"])
    return scaling.melted(cells, names, []).groupBy("feature").agg(F.var_pop("value").alias("variance"))


COLUMNS = ", ".join(f"round({c}, 6) AS {c}" for c in NUMBERS)

QUERIES = {
    "s1_read_features": (lambda s, d: rounded(_read_features(s, d)), f"WITH {CELLS} SELECT roi_id, cell_id, cluster, {COLUMNS}, 'cells.csv' AS source_file FROM cells"),
    "s2_read_many": (lambda s, d: rounded(_read_many(s, d)), f"""WITH {CELLS} SELECT CASE WHEN status = 'F' THEN 'one' ELSE 'two' END AS source_file, roi_id, count(*) AS n, count(price_mean) FILTER (status = 'F')
  AS prices, count(tax_mean) FILTER (status != 'F') AS taxes FROM cells GROUP BY ALL"""),
    "s3_read_edges": (lambda s, d: rounded(_read_edges(s, d)), """SELECT o_orderstatus AS roi_id, o_custkey::BIGINT AS src, o_orderkey::BIGINT AS dst, round(o_totalprice::DOUBLE, 6) AS distance,
  round(o_totalprice::DOUBLE / 2, 6) AS distance_um FROM orders"""),
    "s4_read_spill_matrix": (
        lambda s, d: rounded(_read_matrix(s, d)),
        """WITH m AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS c FROM orders GROUP BY ALL) SELECT a.p AS emitter, b.p AS receiver, CASE WHEN a.p = b.p
  THEN round(a.c, 6) ELSE 0 END AS coeff FROM m a CROSS JOIN m b""",
    ),
    "s5_read_pixels": (
        lambda s, d: rounded(_pixels(s, d)),
        f"WITH {v.GRID} SELECT channel, count(*) AS n, round(sum(value), 5) AS total FROM grid WHERE channel IN ('ch1', 'ch3') GROUP BY ALL",
    ),
    "s9_write_table": (lambda s, d: rounded(_write_table(s, d)), f"WITH {CELLS} SELECT roi_id, cell_id, cluster, {COLUMNS} FROM cells"),
    "s10_write_by_roi": (lambda s, d: rounded(_by_roi(s, d)), f"WITH {CELLS} SELECT roi_id, count(*) AS cells, sum(area_um2) AS area, count(*) AS edges FROM cells GROUP BY ALL"),
    "s11_run_log": (lambda s, d: _run_log(s, d), """SELECT 'cluster' AS type, 'region ' || n_regionkey AS operation, count(*)::VARCHAR AS k, string_agg(n_name, ',' ORDER BY n_name) AS acquisitions FROM
  nation GROUP BY n_regionkey"""),
    "p1_feature_columns": (lambda s, d: rounded(_chosen(s, d)), _chosen_sql()),
    "p2_classify_columns": (lambda s, d: rounded(_classified(s, d)), f"WITH {CELLS} " + " UNION ALL ".join(f"SELECT '{'mean' if c in v.MARKERS else 'morphology'}' AS role, '{c}' AS feature, round(max({c}), 6) AS max FROM cells" for c in NUMBERS)),
    "j13_align_channels": (lambda s, d: rounded(_aligned(s, d, False)), _aligned_sql({"quantity_mean": "q", "tax_mean": "t"})),
    "j13_align_channels_strict": (lambda s, d: rounded(_aligned(s, d, True)), _aligned_sql(dict(zip(v.MARKERS, ["q", "p", "d", "t"], strict=True)))),
    "b1_detect_batch": (lambda s, d: _batches(s, d), f"WITH {CELLS} SELECT 'source_file' AS batch, source_file AS value, count(*) AS n FROM cells GROUP BY ALL"),
    "b2_usable_features": (lambda s, d: rounded(_usable(s, d)), f"WITH {CELLS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_pop({c}), 6) AS variance FROM cells" for c in v.MARKERS)),
}


def _pixels(spark, sf):
    path = _place(spark, "pixels")
    v.grid(spark, sf).write.partitionBy("channel").parquet(path)
    return io.read_pixels(spark, path, channels=["ch1", "ch3"]).groupBy("channel").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total"))
