"""Sums of products of every two channels: pixels become vectors once, and tasks add up block products."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Sums that a task holds before it sends them on, and numbers of a block of vectors.
HELD, BLOCK = 4_000_000, 4_000_000


def pair_products(df: DataFrame, image: str, place: Sequence[str], code: str, value: str) -> DataFrame:
    """``image, a, b, s, n`` for codes a <= b: sum of the products of both values over the
    places of an image that have both, and their number.

    ``code`` numbers channels from 0 inside an image, each once at a place; ``value`` is
    not null. One shuffle, by image and place, so an image of any size is shared out.
    Memory of a task goes with the square of the codes, not with the images.
    """
    kind = df.schema[image].dataType
    shape = T.StructType([T.StructField(image, kind), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])
    schema = to_arrow_schema(shape)

    def rows(held: dict):
        for key, (s, n) in held.items():
            a, b = np.nonzero(np.triu(n))
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(a), schema.field(image).type), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(s[a, b]), pa.array(n[a, b].astype(np.int64))], schema=schema)

    def add(batches):
        held, size = {}, 0
        for batch in batches:
            names = batch.column(image).dictionary_encode(null_encoding="encode")
            keys, of = names.dictionary.to_pylist(), names.indices.to_numpy()
            lists = batch.column("_c")
            flat, length = lists.flatten(), np.diff(lists.offsets.to_numpy())
            at, codes, values = np.repeat(np.arange(len(of)), length), flat.field("c").to_numpy(), flat.field("v").to_numpy()
            wide = int(codes.max()) + 1 if len(codes) else 0
            order = np.argsort(of, kind="stable")
            spot = np.argsort(order)[at]  # a row's place among those of its image
            step = max(1, BLOCK // max(wide, 1))
            for lo in range(0, len(of), step):
                here = (spot >= lo) & (spot < lo + step)
                m = min(step, len(of) - lo)
                x, known = np.zeros((m, wide)), np.zeros((m, wide))
                x[spot[here] - lo, codes[here]], known[spot[here] - lo, codes[here]] = values[here], 1
                image_of = of[order[lo : lo + m]]
                starts = np.flatnonzero(np.diff(image_of, prepend=-1))
                for a, b in zip(starts, [*starts[1:], m], strict=True):
                    key = keys[image_of[a]]
                    s, n = x[a:b].T @ x[a:b], known[a:b].T @ known[a:b]
                    if key in held:
                        big = max(wide, len(held[key][0]))
                        grown = [np.zeros((big, big)) for _ in range(2)]
                        for to, old, new in zip(grown, held[key], (s, n), strict=True):
                            to[: len(old), : len(old)] += old
                            to[:wide, :wide] += new
                        size += big**2 - len(held[key][0]) ** 2
                        held[key] = grown
                    else:
                        held[key] = [s, n]
                        size += wide**2
                    if size > HELD:
                        yield from rows(held)
                        held, size = {}, 0
        yield from rows(held)

    vectors = df.groupBy(image, *place).agg(F.collect_list(F.struct(F.col(code).cast("int").alias("c"), F.col(value).cast("double").alias("v"))).alias("_c"))
    return vectors.select(image, "_c").mapInArrow(add, shape).groupBy(image, "a", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
