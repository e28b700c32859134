"""Reading and writing: cells, edges, matrices, pixels, run logs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import channel_name, unique_acquisition

EDGES = "roi_id string, src long, dst long, distance double, distance_um double"
RUN_LOG = "timestamp string, type string, operation string, parameters map<string,string>, acquisitions array<string>, output_path string, notes string, source_file string"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, or CSV with a head line; CSV types are inferred unless a schema is given."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Cells; ``cell_id`` must be there, ``source_file`` is the file's name if it is not."""
    df = read_table(spark, path)
    if "cell_id" not in df.columns:
        raise ValueError(f"{path} has no cell_id")
    return df if "source_file" in df.columns else df.withColumn("source_file", F.col("_metadata.file_name"))


def read_many(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several feature tables, one below the other; columns may differ."""
    out = read_features(spark, paths[0])
    for path in paths[1:]:
        out = out.unionByName(read_features(spark, path), allowMissingColumns=True)
    return out


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, EDGES)


def read_spill_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A square CSV, names as its first column and head line, as ``emitter, receiver, coeff``."""
    wide = read_table(spark, path)
    first, names = wide.columns[0], wide.columns[1:]
    rows = [r[0] for r in wide.select(first).collect()]  # a panel's channels
    if sorted(map(str, rows)) != sorted(names):
        raise ValueError("the matrix is not square: heads of rows and columns differ")
    return wide.select(F.col(first).cast("string").alias("emitter"), *[F.col(f"`{c}`").cast("double").alias(c) for c in names]).unpivot("emitter", names, "receiver", "coeff")


def read_pixels(spark: SparkSession, path: str, acquisition: str | None = None, channels: Sequence[str] | None = None) -> DataFrame:
    """The long pixel table; an acquisition or channels prune what is read."""
    df = read_table(spark, path)
    df = df if acquisition is None else df.filter(F.col("acq_id") == acquisition)
    return df if channels is None else df.filter(F.col("channel").isin(list(channels)))


def acquisitions(pixels: DataFrame) -> DataFrame:
    """``acq_id, height, width, channels``: the manifest of a pixel table."""
    return pixels.groupBy("acq_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.array_sort(F.collect_set("channel")).alias("channels"))


def image_stack(pixels: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Wide pixels: a column for each channel."""
    return pixels.groupBy("acq_id", "y", "x").pivot("channel", list(channels)).agg(F.first("value"))


def channel_names(acqs: DataFrame, metals: str = "channel_metals", labels: str = "channel_labels") -> DataFrame:
    """``acq_id, idx, channel`` from arrays of metals and labels."""
    zipped = acqs.select("acq_id", F.posexplode(F.arrays_zip(F.col(metals).alias("metal"), F.col(labels).alias("label"))).alias("idx", "c"))
    return zipped.select("acq_id", "idx", channel_name(F.col("c.metal"), F.col("c.label"), F.col("idx")).alias("channel"))


def split_channel(channel: F.Column) -> tuple[F.Column, F.Column]:
    """(label, metal) of a joined channel name."""
    parts = F.split(channel, "_")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "_")), F.element_at(parts, -1)


def with_unique_ids(acqs: DataFrame, path: F.Column) -> DataFrame:
    return acqs.withColumn("acq_id", unique_acquisition(F.col("acq_id"), path))


def channel_mismatch(channels: DataFrame) -> DataFrame:
    """``source_file, channel``: channels that other files have and the file lacks."""
    own = channels.select("source_file", "channel").distinct()
    every = own.select("source_file").distinct().crossJoin(own.select("channel").distinct())
    return every.join(own, ["source_file", "channel"], "left_anti")


def match_masks(masks: DataFrame, acqs: DataFrame) -> DataFrame:
    """``mask_file, acq_id``: the acquisition whose well, else name or id, stands in the
    file's name; the first by ``idx`` wins. A single mask file goes to all acquisitions.

    masks and acqs are lists of files: Spark broadcasts one if its size allows.
    """
    if masks.limit(2).count() == 1:
        return masks.crossJoin(acqs.select("acq_id")).select("mask_file", "acq_id")
    file = F.lower("mask_file")
    rank = F.when((F.coalesce("well", F.lit("")) != "") & F.contains(file, F.lower("well")), 1).when(F.contains(file, F.lower("name")) | F.contains(file, F.lower("acq_id")), 2)
    met = masks.crossJoin(acqs).withColumn("rank", rank).filter("rank is not null")
    return met.groupBy("mask_file").agg(F.min_by("acq_id", F.struct("rank", "idx")).alias("acq_id"))


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV where the path says so, else Parquet."""
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if path.endswith(".csv") else writer.parquet(path)


def companion(path: str, suffix: str) -> str:
    """Path of a companion table: ``_with_communities``, ``_qc``."""
    stem, dot, end = path.rpartition(".")
    return f"{stem}{suffix}.{end}" if dot and "/" not in end else path + suffix


def write_by_roi(cells: DataFrame, edges: DataFrame, path: str, combined: bool = False, key: str = "roi_id") -> None:
    """Cells and edges under ``path``, parted by region or as one table each."""
    for name, df in (("cells", cells), ("edges", edges)):
        writer = df.write if combined else df.repartition(key).write.partitionBy(key)
        writer.parquet(f"{path}/{name}")


def append_run_log(spark: SparkSession, path: str, type_: str, operation: str, parameters: dict | None = None, acquisitions: Sequence[str] = (), output_path: str | None = None, notes: str | None = None, source_file: str | None = None) -> None:
    """One JSON line for an analysis."""
    row = (datetime.now(UTC).isoformat(), type_, operation, {k: str(v) for k, v in (parameters or {}).items()}, list(acquisitions), output_path, notes, source_file)
    spark.createDataFrame([row], RUN_LOG).write.mode("append").json(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG).json(path)


def clustering_output(cells: DataFrame, labels: DataFrame, key: Sequence[str] = ("roi_id", "cell_id")) -> DataFrame:
    """All features with ``cluster, cluster_phenotype, manual_phenotype``; missing ones 0 or empty."""
    names = ["cluster", "cluster_phenotype", "manual_phenotype"]
    own = labels.select(*key, *[c for c in names if c in labels.columns])
    out = cells.drop(*names).join(own, list(key), "left")
    for c in names:
        default = F.lit(0) if c == "cluster" and c in own.columns and not isinstance(own.schema[c].dataType, T.StringType) else F.lit("")
        out = out.withColumn(c, F.coalesce(F.col(c), default) if c in out.columns else default)
    return out


def acquisition_list(cells: DataFrame, key: Sequence[str], order: Sequence[str] = ("cell_id",)) -> DataFrame:
    """The first row of each group by ``order``."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return cells.withColumn("_p", place).filter("_p = 1").drop("_p")
