"""Shared pieces: reading tables, names, ids, numbers of tasks; lineage and prefix sums come from the core."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import checkpointed, discard, saved, shared_dir  # noqa: F401
from ..functions.prefix import running_sums  # noqa: F401

#: White space between words: space and the control characters 09 to 0D. Fixed value of the data contract.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text for which a shuffle gets another task, whatever the session's number of them.
TASK_BYTES = 64 << 20


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0


def tasks(spark: SparkSession, size: int) -> int:
    """Tasks of a shuffle of what ``size`` bytes of text become."""
    return max(partitions(spark), size // TASK_BYTES)


def whole_id(docs: DataFrame, id_col: str) -> Column:
    """The id as a long; an error at once where the column is not of whole numbers."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers, not {kind.simpleString()}")
    return F.col(f"`{id_col}`").cast("long")


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(df: DataFrame, seed: str = "") -> Column:
    """One 64-bit hash of all columns of a row; maps count by their JSON."""
    cols = [F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(F.lit(seed), *cols)


def with_columns(batch: pa.RecordBatch, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns.values())], names=[*batch.schema.names, *columns])
