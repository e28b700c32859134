"""Contiguous shards of near equal size, cut from a global prefix sum of bytes.

Documents stand in one global order (id, then a hash of the whole row). The
sizes of each range of that order are summed, the totals become offsets, and a
document goes to the shard in whose stretch of bytes its middle lies. So each
border is the one nearest to its target, a shard is at most one document off,
and no task sees more than its range. Only narrow rows are sorted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, row_hash, running_sums, saved, with_columns


def byte_size(text: str) -> F.Column:
    """UTF-8 bytes of the text and one for the line end; null counts as empty."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def assign_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns ``id_col, size, text_crc32, row_key, shard, slot``, a row for each document.

    ``slot`` counts from 0 in each shard without gaps. Null text has size 1 and
    CRC 0; null ids come last; rows that are equal throughout take neighbouring
    places, whichever comes first; a document larger than a shard's share makes
    some shards empty; an empty table gives no rows. Other columns only enter
    the row's hash, so their names cannot clash.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    narrow = docs.select(
        F.col(id_col).alias("id"),
        byte_size(text_col).alias("size"),
        F.coalesce(F.crc32(F.col(text_col)), F.lit(0)).cast("long").alias("text_crc32"),
        row_hash(docs).alias("row_key"),
    )
    # Equal rows would be one key of the range sort: the salt lets them spread.
    narrow = saved(narrow).withColumn("salt", F.monotonically_increasing_id()).withColumn("no_id", F.col("id").isNull())
    placed = running_sums(narrow, ["no_id", "id", "row_key", "salt"], "size")
    total = placed.agg(F.max(F.col("_before") + F.col("size"))).first()[0] or 0
    # Twice the targets, to compare with twice the middle: whole numbers only.
    cuts = np.array([2 * k * total // n_shards for k in range(1, n_shards)], np.int64)

    def shard(batch: pa.RecordBatch) -> np.ndarray:
        before, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_before", "size"))
        return np.searchsorted(cuts, 2 * before + size, side="right")

    def counts(batches):
        pid, found = TaskContext.get().partitionId(), np.zeros(n_shards, np.int64)
        for batch in batches:
            found += np.bincount(shard(batch), minlength=n_shards)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"pid": pa.array([pid] * len(at), pa.int32()), "shard": pa.array(at, pa.int32()), "n": pa.array(found[at])})

    starts, ahead = {}, [0] * n_shards
    for r in sorted(placed.mapInArrow(counts, "pid int, shard int, n long").collect(), key=lambda r: (r.pid, r.shard)):
        starts[r.pid, r.shard] = ahead[r.shard]
        ahead[r.shard] += r.n

    def slots(batches):
        pid, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            s = shard(batch)
            slot = np.zeros(len(s), np.int64)
            for k in map(int, np.unique(s)):  # shards are contiguous: few in a partition
                at = np.flatnonzero(s == k)
                first = seen.get(k, starts[pid, k])
                slot[at] = first + np.arange(len(at))
                seen[k] = first + len(at)
            kept = pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "size", "text_crc32", "row_key")], names=["id", "size", "text_crc32", "row_key"])
            yield with_columns(kept, shard=s.astype(np.int32), slot=slot)

    kind = docs.schema[id_col].dataType.simpleString()
    return placed.mapInArrow(slots, f"id {kind}, size long, text_crc32 long, row_key long, shard int, slot long").withColumnRenamed("id", id_col)


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents as Parquet under ``path/shard=N`` and returns the assignment.

    Rows equal in all columns go together, to the first of their shards.
    """
    placed = saved(assign_shards(docs, n_shards, id_col, text_col))
    keyed = docs.withColumn("row_key", row_hash(docs))
    once = placed.groupBy("row_key").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    joined = keyed.join(once, "row_key").withColumn("shard", F.element_at("shards", 1)).drop("row_key", "shards")
    joined.repartitionByRange(max(n_shards, partitions(docs.sparkSession)), "shard", id_col).sortWithinPartitions("shard", id_col).write.partitionBy("shard").parquet(path)
    return placed
