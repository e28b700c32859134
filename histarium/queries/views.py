"""The driver's tables as imaging tables, in Spark and, for the oracle, in SQL.

``flat``: pixels without places from ``lineitem``, an order being a cell;
``grid``: 8 x 8 images of four channels from ``embeddings``; ``mask``: four cells
on each, the first row being background; ``cells``: ``orders`` as points in 20
regions, labelled by priority, with intensities from ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import large

CHANNELS = ["quantity", "extendedprice", "discount", "tax"]
GRID_CHANNELS = ["ch0", "ch1", "ch2", "ch3"]
CLUSTERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
DIMS = 64  # components of embeddings
MARKERS = ["quantity_mean", "price_mean", "discount_mean", "tax_mean"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).cast("string").alias("acq_id"), F.col("l_orderkey").alias("cell_id"), *[F.col(f"l_{c}").alias(c) for c in CHANNELS])
    return t.unpivot(["acq_id", "cell_id"], CHANNELS, "channel", "value")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return t.select(F.expr("vec_id div 4").cast("string").alias("acq_id"), F.expr("cast(pos div 8 as int)").alias("y"), (F.col("pos") % 8).cast("int").alias("x"), F.concat(F.lit("ch"), F.col("vec_id") % 4).alias("channel"), F.col("v").cast("double").alias("value"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos")
    # Dealt out in turn, as Spark would join few ids to one task, which then makes all pixels.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").cast("string").alias("acq_id")).distinct().repartition(n).select("acq_id", at)
    y, x = F.expr("cast(pos div 8 as int)"), (F.col("pos") % 8).cast("int")
    cell = F.when(y == 0, 0).otherwise(F.expr("cast(1 + 2 * ((pos div 8) div 4) + ((pos % 8) div 4) as int)"))
    return t.select("acq_id", y.alias("y"), x.alias("x"), cell.alias("cell_id"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    m = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(F.avg("l_quantity").alias("quantity_mean"), F.avg("l_extendedprice").alias("price_mean"), F.avg("l_discount").alias("discount_mean"), F.avg("l_tax").alias("tax_mean"), F.count("*").cast("double").alias("area_um2"))
    p = o.select((F.col("o_custkey") % 20).cast("string").alias("roi_id"), F.col("o_orderkey").alias("cell_id"), (F.col("o_orderkey") * 7919 % 10007 / 10).alias("x"), (F.col("o_orderkey") * 104729 % 10007 / 10).alias("y"), F.col("o_orderpriority").alias("cluster"), F.concat(F.lit("file"), F.col("o_orderkey") % 3).alias("source_file"), F.col("o_orderstatus").alias("status"))
    return p.join(large(m), "cell_id", "left").select("roi_id", "cell_id", "x", "y", "cluster", "source_file", "status", *MARKERS, "area_um2")


def even_spill(spark: SparkSession, channels: list[str], coeff: float = 0.05) -> DataFrame:
    """A matrix in which every channel spills the same share into every other."""
    return spark.createDataFrame([(a, b, 1.0 if a == b else coeff) for a in channels for b in channels], "emitter string, receiver string, coeff double")


def vectors(spark: SparkSession, sf_dir: str, dims: int = DIMS) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 3).alias("batch"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""

    def one(f) -> Column:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        return (F.round(c, digits) + F.lit(0.0)).alias(f.name) if kind == "double" else c.cast("long").alias(f.name) if kind in ("integer", "short", "byte") else c

    return df.select(*[one(f) for f in df.schema.fields])


FLAT = """flat AS (SELECT (l_orderkey % 10)::VARCHAR AS acq_id, l_orderkey AS cell_id, unnest(['quantity', 'extendedprice', 'discount', 'tax']) AS channel,
  unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem)"""
GRID = """grid AS (SELECT (vec_id // 4)::VARCHAR AS acq_id, pos // 8 AS y, pos % 8 AS x, 'ch' || (vec_id % 4) AS channel, v::DOUBLE AS value FROM (SELECT
  vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))"""
MASK = """mask AS (SELECT acq_id, pos // 8 AS y, pos % 8 AS x, CASE WHEN pos < 8 THEN 0 ELSE 1 + 2 * (pos // 32) + (pos % 8) // 4 END AS cell_id FROM (SELECT
  DISTINCT (vec_id // 4)::VARCHAR AS acq_id FROM embeddings), (SELECT unnest(range(64)) AS pos))"""
CELLS = """cells AS (SELECT (o_custkey % 20)::VARCHAR AS roi_id, o_orderkey AS cell_id, o_orderkey * 7919 % 10007 / 10 AS x, o_orderkey * 104729 % 10007 / 10 AS
  y, o_orderpriority AS cluster, 'file' || (o_orderkey % 3) AS source_file, o_orderstatus AS status, quantity_mean, price_mean, discount_mean,
  tax_mean, area_um2
  FROM orders LEFT JOIN (SELECT l_orderkey AS k, avg(l_quantity) AS quantity_mean, avg(l_extendedprice) AS price_mean, avg(l_discount) AS
  discount_mean, avg(l_tax) AS tax_mean, count(*)::DOUBLE AS area_um2 FROM lineitem GROUP BY 1) ON k = o_orderkey)"""
