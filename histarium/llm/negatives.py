"""Hard negatives by whole-number inner products, scored from tables of subset sums.

Components are whole numbers. A candidate is kept as bit planes: for each bit of
its components (two's complement), one byte for each eight dimensions. For an
anchor, each group of eight dimensions has a table of the sums of all 256 subsets
of its components; a candidate's byte looks its sum up, and the planes are added
by shifts, the sign's plane taken off. So scores are exact, whatever the vectors.

Anchors are a stated query set against all rows, in blocks: a pass takes
``ANCHORS_OF_A_PASS`` anchors to all candidates without a shuffle of these, and
each task sends on the few best of its rows for each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, running_sums, saved

#: Anchors that go to all candidates at once: 4 MB at 128 dimensions.
ANCHORS_OF_A_PASS = 4096
#: Anchors whose tables, and candidates whose scores, are held at a time.
ANCHORS, ROWS = 128, 2048
POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these shares of its positive's score, in percent.
LOWEST, HIGHEST = 50, 95


def subset_tables(anchors: np.ndarray) -> np.ndarray:
    """``(groups, 256, anchors)``: of each eight dimensions, the sum of each subset of an anchor's components."""
    n, dims = anchors.shape
    padded = np.zeros((n, -(-dims // 8) * 8), np.int64)
    padded[:, :dims] = anchors
    groups = padded.reshape(n, -1, 8).transpose(1, 2, 0)
    out = np.zeros((groups.shape[0], 256, n), np.int64)
    for bit in range(8):
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + groups[:, bit : bit + 1]
    return out


def bit_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """``(rows, bits, groups)`` bytes: bit ``i`` of a byte belongs to the i-th of its eight dimensions."""
    n, dims = values.shape
    padded = np.zeros((n, -(-dims // 8) * 8), np.int64)
    padded[:, :dims] = values
    planes = (padded[:, None, :] >> np.arange(bits)[None, :, None] & 1).astype(np.uint8)
    return np.packbits(planes, axis=2, bitorder="little")


def table_scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """``(rows, anchors)`` inner products, by look-ups, shifts and additions alone."""
    rows, bits, groups = planes.shape
    total = np.zeros((rows, tables.shape[2]), np.int64)
    for bit in range(bits - 1, -1, -1):
        plane = np.zeros_like(total)
        for group in range(groups):
            plane += tables[group].take(planes[:, bit, group], axis=0)
        total = (total << 1) - plane if bit == bits - 1 else (total << 1) + plane
    return total


def _whole(vectors: DataFrame, anchors: Column, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``row, id, code, anchor, top, v``: rows that take part; components as whole numbers, and the largest before rounding."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double") * scale)
    held = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), x.alias("x"))
    code = F.col("label").cast("long") if isinstance(held.schema["label"].dataType, T.IntegralType) else F.xxhash64("label")
    good = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    held = held.filter("id is not null and label is not null and x is not null").filter(good)
    held = held.withColumn("top", F.coalesce(F.array_max(F.transform("x", F.abs)), F.lit(0.0)))
    whole = F.when(F.col("top") < 2.0**30, F.transform("x", lambda c: F.floor(c).cast("long")))
    return held.select(F.monotonically_increasing_id().alias("row"), "id", code.alias("code"), "anchor", "top", whole.alias("v"))


def _packed(whole: DataFrame, bits: int, dims: int) -> DataFrame:
    """``row, id, code, planes``: the bit planes of each row's components, missing ones being 0."""

    def pack(batches):
        for batch in batches:
            planes = bit_planes(_matrix(batch.column("v"), dims), bits).reshape(batch.num_rows, -1)
            packed = pa.array([p.tobytes() for p in planes], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "code")), packed], names=["row", "id", "code", "planes"])

    return whole.select("row", "id", "code", "v").mapInArrow(pack, T.StructType([*[whole.schema[c] for c in ("row", "id", "code")], T.StructField("planes", T.BinaryType())]))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` numbers, shorter ones filled up with 0."""
    out = np.zeros((len(lists), dims), np.int64)
    first = lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(first)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(first[:-1] - first[0], sizes)] = flat
    return out


def _firsts(group: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` first of each group: higher scores, then smaller ids, then earlier rows."""
    order = np.lexsort((row, ident, -score, group))
    own = group[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
    return order[place < most]


class _Best:
    """The first few of each group seen so far; what cannot be among them is passed over."""

    def __init__(self, groups: int, most: int) -> None:
        self.most, self.held = most, [np.zeros(0, np.int64) for _ in range(4)]
        self.score, self.ident = np.full(groups, np.iinfo(np.int64).min), np.full(groups, np.iinfo(np.int64).max)

    def hopeful(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> np.ndarray:
        bar = self.score[group]
        return (score > bar) | ((score == bar) & (ident <= self.ident[group]))

    def add(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        if not len(group):
            return
        all_ = [np.concatenate(p) for p in zip(self.held, (group, score, ident, row), strict=True)]
        at = _firsts(*all_, self.most)
        self.held = [c[at] for c in all_]
        own = self.held[0]
        last = np.flatnonzero(np.r_[own[1:] != own[:-1], True])
        size = np.diff(np.r_[-1, last])
        full = last[size == self.most]
        self.score[own[full]], self.ident[own[full]] = self.held[1][full], self.held[2][full]


def _planes(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[np.ndarray, ...]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        raw = np.frombuffer(b"".join(part.column("planes").to_pylist()), np.uint8)
        yield (*(part.column(c).to_numpy() for c in ("row", "id")), part.column("code").to_numpy(), raw.reshape(part.num_rows, bits, -1))


def _found(best: _Best, names: list[str], anchors: np.ndarray) -> pa.RecordBatch:
    group, score, ident, row = best.held
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (anchors[group], score, ident, row)], names=names)


def _pass(candidates: DataFrame, anchors: list, bits: int, dims: int, positives: int, negatives: int, lowest: int, highest: int) -> DataFrame:
    """Positives and negatives of one block of anchors: ``anchor, positive, p_score, rank, negative, n_score`` by row."""
    values = np.zeros((len(anchors), dims), np.int64)
    for i, a in enumerate(anchors):
        values[i, : len(a.v)] = a.v
    rows, labels = np.array([a.row for a in anchors]), np.array([a.code for a in anchors])
    order = np.argsort(labels, kind="stable")  # anchors of a label stand together
    values, rows, labels = values[order], rows[order], labels[order]

    def near(batches):
        best = _Best(len(rows), positives)
        for batch in batches:
            for row, ident, code, planes in _planes(batch, bits):
                for kind in np.intersect1d(code, labels).tolist():
                    mine, of = np.flatnonzero(code == kind), np.flatnonzero(labels == kind)
                    for block in (of[i : i + ANCHORS] for i in range(0, len(of), ANCHORS)):
                        score = table_scores(planes[mine], subset_tables(values[block]))
                        at, anchor = np.nonzero(best.hopeful(block[None, :], score, ident[mine][:, None]) & (row[mine][:, None] != rows[block][None, :]))
                        best.add(block[anchor], score[at, anchor], ident[mine][at], row[mine][at])
        yield _found(best, ["anchor", "score", "id", "row"], np.arange(len(rows)))

    by_score = [F.desc("score"), "id", "row"]
    first = lambda df, by, most: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*by_score))).filter(F.col("rank") <= most)
    found = first(candidates.mapInArrow(near, "anchor long, score long, id long, row long"), ["anchor"], positives).collect()  # at most `positives` an anchor
    score = np.full((len(rows), positives), np.iinfo(np.int64).min)
    for r in found:
        score[r.anchor, r["rank"] - 1] = r.score
    known = score > np.iinfo(np.int64).min
    low = np.where(known, -(-score * lowest // 100), 1)  # the least whole score that will do
    high = np.where(known, score * highest // 100, 0)

    def far(batches):
        best = _Best(len(rows) * positives, negatives)
        least, most = np.where(low <= high, low, np.iinfo(np.int64).max).min(axis=1), np.where(low <= high, high, np.iinfo(np.int64).min).max(axis=1)
        tables = {}
        for batch in batches:
            for row, ident, code, planes in _planes(batch, bits):
                for start in range(0, len(rows), ANCHORS):
                    block = np.arange(start, min(start + ANCHORS, len(rows)))
                    if len(tables) < 8 and start not in tables:
                        tables[start] = subset_tables(values[block])
                    score = table_scores(planes, tables[start] if start in tables else subset_tables(values[block]))
                    at, anchor = np.nonzero((score >= least[block]) & (score <= most[block]))
                    anchor_row = block[anchor]
                    good = code[at] != labels[anchor_row]
                    at, anchor, anchor_row = at[good], anchor[good], anchor_row[good]
                    s, i, r = score[at, anchor], ident[at], row[at]
                    for p in range(positives):
                        group = anchor_row * positives + p
                        ok = (s >= low[anchor_row, p]) & (s <= high[anchor_row, p])
                        ok &= best.hopeful(group, s, i)
                        best.add(group[ok], s[ok], i[ok], r[ok])
        yield _found(best, ["pair", "score", "id", "row"], np.arange(len(rows) * positives))

    chosen = first(candidates.mapInArrow(far, "pair long, score long, id long, row long"), ["pair"], negatives)
    anchor_ids = [a.id for a in anchors]
    pairs = [(int(r.anchor) * positives + r["rank"] - 1, int(anchor_ids[order[r.anchor]]), r.id, r.score) for r in found]
    spark = candidates.sparkSession
    told = spark.createDataFrame(pairs, "pair long, anchor_id long, positive_id long, positive_score long")
    return chosen.join(told, "pair").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_negatives(
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    label: Column | None = None,
    scale: int = 256,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors``: which rows are anchors; ``label``: replaces ``label_col``. A
    component x becomes floor(scale * x). Rows that lack an id, a label, a vector
    or a finite component take no part. An anchor's positives are its first other
    rows of the same label; of each positive, the first rows of another label that
    score between ``lowest`` and ``highest`` percent of it are returned. Higher
    scores come first, then smaller ids. Rows with one id are rows of their own,
    each an anchor too; shorter vectors count as filled up with 0, and an empty
    one scores 0 with all. Anchors without positives, and positives without
    negatives, have no rows; an empty table gives none. Scores that might leave
    64 bits are an error. Labels that are not whole numbers are told apart by 64
    bits of a hash. Other columns play no part.
    """
    whole = saved(_whole(vectors, anchors, F.col(label_col) if label is None else label, id_col, vector_col, scale))
    top, dims = whole.agg(F.max("top"), F.max(F.size("v"))).first()
    dims = max(dims or 0, 1)
    if (top or 0) >= 2.0**30 or dims * (int(top or 0) + 1) ** 2 >= 1 << 56:
        raise ValueError("components are too large for exact scores in 64 bits")
    bits = (int(top or 0) + 1).bit_length() + 1
    packed = saved(_packed(whole, bits, dims))
    queries = saved(running_sums(whole.filter("anchor").select("id", "row", "code", "v").withColumn("one", F.lit(1)), ["id", "row"], "one"))
    discard(whole)
    parts: list[list[DataFrame]] = []
    for start in range(0, max(queries.count(), 1), ANCHORS_OF_A_PASS):
        block = queries.filter(F.col("_index").between(start, start + ANCHORS_OF_A_PASS - 1)).select("id", "row", "code", "v").collect()  # ANCHORS_OF_A_PASS at most
        _gather(parts, saved(_pass(packed, block, bits, dims, positives, negatives, lowest, highest)))
    out = [t for level in parts for t in level]
    return reduce(DataFrame.unionByName, out)


def _gather(parts: list[list[DataFrame]], table: DataFrame, most: int = 16) -> None:
    """Puts ``table`` to the results so far, of which ``most`` of a kind become one, so that the plan stays small."""
    for level in parts:
        level.append(table)
        if len(level) < most:
            return
        table = saved(reduce(DataFrame.unionByName, level))
        discard(*level)
        level.clear()
    parts.append([table])
