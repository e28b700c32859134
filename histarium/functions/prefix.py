"""Prefix sums over a global order, and the ranks and quantiles that follow from them.

A range sort deals rows out by the order, so a key with very many rows is spread
over tasks; the totals of partitions, two rows for each, become offsets. No task
holds a group, only a range of the order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .lineage import checkpointed


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (a fixed permutation)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def changes(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Whether a row is the first or differs in ``columns`` from the row before."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for c in columns:
        codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return new


def runs(batch: pa.RecordBatch, columns: Sequence[str]) -> list[tuple[tuple, int, int]]:
    """(values, first row, row after the last) of each stretch of rows equal in ``columns``."""
    starts = np.flatnonzero(changes(batch, columns)).tolist()
    return [(tuple(batch.column(c)[a].as_py() for c in columns), a, b) for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True)]


def running_sums(df: DataFrame, order: Sequence[str], sizes: str | Sequence[str], group: str | Sequence[str] | None = None) -> DataFrame:
    """Adds ``_before`` and ``_index``: sum of ``sizes`` and number of rows ahead
    of a row in the global ``order``; with ``group``, ahead of it in its group.

    Of several ``sizes``, whole numbers all, each has its ``_before_{name}``.
    With ``group``, ``order`` must begin with it. ``df`` should be narrow: a
    checkpoint, which fixes the partitions, writes it once. The driver gets two
    rows for each partition: its first group and its last.
    """
    names = [sizes] if isinstance(sizes, str) else list(sizes)
    by = [group] if isinstance(group, str) else list(group or ())
    added = ["_before"] if isinstance(sizes, str) else [f"_before_{s}" for s in names]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    shape = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("place", T.IntegerType()), *[df.schema[c] for c in by], T.StructField("_rows", T.LongType()), *[T.StructField(f"_sum{i}", T.LongType()) for i in range(len(names))]])
    schema = to_arrow_schema(shape)

    def column(batch, name: str) -> np.ndarray:
        return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)

    def totals(batches):
        pid, ends, count = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            values = [column(batch, s) for s in names]
            for key, a, b in runs(batch, by):
                now = np.array([b - a, *[int(v[a:b].sum()) for v in values]])
                if count and ends[-1][0] == key:
                    ends[-1] = key, ends[-1][1] + now
                else:  # only the first group and the last matter to other partitions
                    ends, count = [*ends[:1], (key, now)], count + 1
        if count:
            rows = [{"pid": pid, "place": i, **dict(zip(by, key, strict=True)), "_rows": int(v[0]), **{f"_sum{k}": int(x) for k, x in enumerate(v[1:])}} for i, (key, v) in enumerate(ends)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    told: dict[int, list] = {}
    for r in dealt.mapInArrow(totals, shape).collect():
        told.setdefault(r.pid, []).append((r.place, tuple(r[c] for c in by), np.array([r["_rows"], *[r[f"_sum{i}"] for i in range(len(names))]])))
    zero = np.zeros(1 + len(names), np.int64)
    offsets, open_key, open_sums = {}, None, zero
    for pid in sorted(told):
        ends = sorted(told[pid], key=lambda e: e[0])
        offsets[pid] = open_sums if ends[0][1] == open_key else zero
        open_key, open_sums = ends[-1][1], ends[-1][2] + (offsets[pid] if len(ends) == 1 else zero)

    def add(batches):
        pid = TaskContext.get().partitionId()
        last, at = None, offsets.get(pid)
        for batch in batches:
            before = [np.zeros(batch.num_rows, np.int64) for _ in names]
            index = np.zeros(batch.num_rows, np.int64)
            values = [column(batch, s) for s in names]
            for key, a, b in runs(batch, by):
                if last is not None and key != last:
                    at = zero
                index[a:b] = at[0] + np.arange(b - a)
                sums = [np.cumsum(v[a:b]) for v in values]
                for k, (s, v) in enumerate(zip(sums, values, strict=True)):
                    before[k][a:b] = at[k + 1] + s - v[a:b]
                last, at = key, at + np.array([b - a, *[int(s[-1]) for s in sums]])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, before), pa.array(index)], names=[*batch.schema.names, *added, "_index"])

    return dealt.mapInArrow(add, T.StructType([*dealt.schema.fields, *[T.StructField(c, T.LongType()) for c in [*added, "_index"]]]))


def counted(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by, value, _n, _before``: distinct values with their numbers of rows and of rows below in the group."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    return running_sums(counts, [*by, value], "_n", by).drop("_index")


def average_rank(df: DataFrame, by: Sequence[str], value: str, to: str = "rank") -> DataFrame:
    """Adds ranks in each group, ties sharing their mean rank; rows with a null key or value go.

    Values are counted before they are ranked, so a value of many rows is one row.
    """
    ranked = counted(df, by, value).select(*by, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(to))
    return df.join(ranked, [*by, value])


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], to: str = "q") -> DataFrame:
    """``by`` and the array ``to``: exact quantiles by linear interpolation, nulls left out.

    A group without values has no row.
    """
    steps = counted(df.filter(F.col(value).isNotNull()).select(*by, value), by, value)
    sizes = steps.groupBy(*by).agg(F.max(F.col("_before") + F.col("_n")).alias("_all"))
    held = steps.join(sizes, list(by)) if by else steps.crossJoin(sizes)  # one row without a group
    places = [F.lit(float(s)) * (F.col("_all") - 1) for s in shares]
    inside = lambda p: (F.col("_before") <= p) & (p < F.col("_before") + F.col("_n"))
    wanted = [(F.floor(p), F.ceil(p)) for p in places]
    hit = F.lit(False)
    for lo, hi in wanted:
        hit = hit | inside(lo) | inside(hi)
    pick = lambda p: F.max(F.when(inside(p), F.col(value).cast("double")))
    found = held.filter(hit).groupBy(*by).agg(F.max("_all").alias("_all"), *[pick(p).alias(f"_{k}{i}") for i, pair in enumerate(wanted) for k, p in zip("ab", pair, strict=True)])
    between = [F.col(f"_a{i}") + (p - F.floor(p)) * (F.col(f"_b{i}") - F.col(f"_a{i}")) for i, p in enumerate(places)]
    return found.select(*by, F.array(*between).alias(to))
