"""Merkle manifest of a table, its nodes labelled by the leaf ranks they cover.

Rows are leaves, one tree for each value of a column, and the roots of these
trees are leaves of the tree on top. A node carries its level and the interval
``[lo, hi)`` of the leaf ranks below it. Levels are taken in buckets of a few,
so that a bucket's part of a tree is at most ``BLOCK`` nodes wide: such parts
are built, and later met by the nodes below them, by an equality join on the
part in which a node's interval lies. A node's ancestors are those whose
interval holds its own; its siblings are the difference of its parent's interval
and its own. No task holds more than a part, whatever the size of a tree.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, row_hash, running_sums, saved

#: Columns of ``documents`` that a leaf takes in, in this order. Fixed value of the data contract.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a part of a tree, at most.
BLOCK = 4096
#: Tampering hits rows whose id has a CRC divisible by this. Fixed value of the data contract.
TAMPERED = 7
STEPS = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    """Digest of a row: lowercase hex SHA-256 of its fields one after the other."""
    return F.sha2(F.concat(*map(field, values)), 256)


def tree_key(tree: Column) -> Column:
    """A key of the tree that is never null and sorts as it, null first, by UTF-8 bytes."""
    text = tree.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.lit("="), text))


def _spans(fanout: int) -> tuple[int, int]:
    """Levels of a bucket, and leaves below a node of its top level."""
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    levels = 1
    while fanout ** (levels + 1) <= BLOCK:
        levels += 1
    return levels, fanout**levels


def _part(width: int) -> Column:
    """The part of its tree in which a node's interval lies, parts being ``width`` leaves wide."""
    return F.expr(f"lo div {width}") if width < 1 << 62 else F.lit(0).cast("long")


def _ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (with ``tree``) with intervals ``lo, hi`` of one leaf, and ``n`` leaves of the tree."""
    placed = running_sums(leaves.withColumn("one", F.lit(1)), ["tree", *order], "one", "tree").drop("one", "_before")
    sizes = placed.groupBy("tree").agg(F.count("*").alias("n"))
    return placed.join(sizes, "tree").withColumnRenamed("_index", "lo").withColumn("hi", F.col("lo") + 1)


def _climb(fanout: int, levels: int):
    """Inner nodes of a part of a tree, up to ``levels`` above its base or the tree's root."""

    def climb(key, part):
        order = np.argsort(part.column("lo").to_numpy())
        lo, hi = (part.column(c).to_numpy()[order] for c in ("lo", "hi"))
        digests, n = part.column("digest").take(pa.array(order)).to_pylist(), part.column("n")[0].as_py()
        level, found = part.column("level")[0].as_py(), {c: [] for c in ("level", "lo", "hi", "digest")}
        for _ in range(levels):
            if lo[0] == 0 and hi[-1] == n and len(lo) == 1:  # the root of its tree
                break
            first = np.arange(0, len(lo), fanout)
            level, lo, hi = level + 1, lo[first], hi[np.minimum(first + fanout, len(hi)) - 1]
            digests = [sha256("".join(digests[i : i + fanout]).encode()).hexdigest() for i in first.tolist()]
            for c, v in (("level", [level] * len(lo)), ("lo", lo.tolist()), ("hi", hi.tolist()), ("digest", digests)):
                found[c] += v
        size = len(found["lo"])
        return pa.table({"tree": pa.array([key[0].as_py()] * size, pa.string()), "level": pa.array(found["level"], pa.int32()), **{c: pa.array(found[c], pa.int64()) for c in ("lo", "hi")}, "digest": pa.array(found["digest"], pa.string()), "n": pa.array([n] * size, pa.int64())})

    return climb


def _grow(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """Inner nodes ``tree, level, lo, hi, digest, n``, a saved table for each bucket of levels."""
    levels, width = _spans(fanout)
    most = leaves.agg(F.max("n")).first()[0] or 0
    base, out, below = leaves.select("tree", F.lit(0).alias("level"), "lo", "hi", "digest", "n"), [], 1
    while most > below or not out:
        below *= width
        nodes = base.withColumn("part", _part(below)).groupBy("tree", "part").applyInArrow(_climb(fanout, levels), "tree string, level int, lo long, hi long, digest string, n long")
        out.append(saved(nodes))
        base = out[-1].filter((F.col("level") == levels * len(out)) & (F.col("n") > below))
    return out


def _attach(own: DataFrame, nodes: list[DataFrame], tops: DataFrame, fanout: int, carried: list[str], bucket: int = 0) -> DataFrame:
    """``own`` (nodes at the base of a bucket of levels) with the steps from each to the root on top.

    Returns ``tree, lo, carried, digest, steps, subroot, root``.
    """
    levels, width = _spans(fanout)
    part = _part(width ** (bucket + 1))
    if bucket + 1 < len(nodes):
        above = nodes[bucket].filter((F.col("level") == levels * (bucket + 1)) & (F.col("n") > width ** (bucket + 1)))
        rest = _attach(above, nodes, tops, fanout, [], bucket + 1).select("tree", "lo", "steps", "subroot", "root")
        whole = tops.filter((F.col("n") <= width ** (bucket + 1)) & ((F.col("n") > width**bucket) | F.lit(bucket == 0)))
        known = rest.unionByName(whole.select("tree", F.lit(0).cast("long").alias("lo"), "steps", "subroot", "root"))
    else:
        known = tops.filter((F.col("n") > width**bucket) | F.lit(bucket == 0)).select("tree", F.lit(0).cast("long").alias("lo"), "steps", "subroot", "root")
    blank = {"steps": F.lit(None).cast(STEPS), "subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string"), "level": F.lit(None).cast("int"), "hi": F.lit(None).cast("long"), "digest": F.lit(None).cast("string")}
    cols = ["tree", "part", "level", "lo", "hi", "digest", "steps", "subroot", "root"]
    inner = nodes[bucket].withColumns({c: blank[c] for c in ("steps", "subroot", "root")}).withColumn("part", part).select(cols)
    right = inner.unionByName(known.withColumns({c: blank[c] for c in ("level", "hi", "digest")}).withColumn("part", part).select(cols))
    left = own.withColumn("part", part).select("tree", "part", "lo", "hi", "digest", *carried)

    def meet(key, below, above):
        order = pa.array(np.argsort(below.column("lo").to_numpy()))
        below = below.take(order).combine_chunks()
        is_node = np.array([s is None for s in above.column("root").to_pylist()], bool)
        top = above.filter(pa.array(~is_node)).slice(0, 1)
        inner = above.filter(pa.array(is_node))
        at = inner.column("level").to_numpy()
        held = [tuple(below.column(c) for c in ("lo", "hi", "digest"))]
        for level in np.unique(at).tolist():
            own = inner.filter(pa.array(at == level))
            own = own.take(pa.array(np.argsort(own.column("lo").to_numpy())))
            held.append(tuple(own.column(c) for c in ("lo", "hi", "digest")))
        held = [(lo.to_numpy(), hi.to_numpy(), digest.to_pylist()) for lo, hi, digest in held]
        ranks, left, right, picks = held[0][0], [], [], []
        for (lo, hi, digest), (parent_lo, parent_hi, _) in zip(held, held[1:], strict=False):
            parent = np.searchsorted(parent_lo, lo, side="right") - 1
            if not ((parent_lo[parent] <= lo) & (hi <= parent_hi[parent])).all():
                raise AssertionError("a node lies outside its parent's interval")
            first, last = np.searchsorted(lo, parent_lo[parent]), np.searchsorted(lo, parent_hi[parent])
            picks.append(len(left) + np.searchsorted(lo, ranks, side="right") - 1)
            for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):  # the parent's interval less the node's own
                left.append("".join(digest[a:i]))
                right.append("".join(digest[i + 1 : b]))
        rest = top.column("steps")[0].as_py()
        for step in rest:
            picks.append(np.full(len(ranks), len(left)))
            left.append(step["left"])
            right.append(step["right"])
        pick = pa.array(np.stack(picks, axis=1).ravel() if picks else np.zeros(0, np.int64))
        flat = pa.StructArray.from_arrays([pa.array(left, pa.string()).take(pick), pa.array(right, pa.string()).take(pick)], fields=list(_STEP))
        steps = pa.ListArray.from_arrays(pa.array(np.arange(len(ranks) + 1, dtype=np.int32) * len(picks)), flat)
        once = {c: pa.array([top.column(c)[0].as_py()] * len(ranks), pa.string()) for c in ("subroot", "root")}
        return pa.table({"tree": below.column("tree"), "lo": below.column("lo"), **{c: below.column(c) for c in carried}, "digest": below.column("digest"), "steps": steps, **once})

    def shape() -> T.StructType:
        kinds = [T.StructField("tree", T.StringType()), T.StructField("lo", T.LongType()), *[own.schema[c] for c in carried]]
        return T.StructType([*kinds, T.StructField("digest", T.StringType()), T.StructField("steps", STEPS), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())])

    return left.groupBy("tree", "part").cogroup(right.toDF("tree", "part", *cols[2:]).groupBy("tree", "part")).applyInArrow(meet, shape())


def _roots(leaves: DataFrame, nodes: list[DataFrame]) -> DataFrame:
    """``tree, n, digest``: the node that covers each tree whole."""
    own = leaves.filter("n = 1").select("tree", "n", "digest")
    for table in nodes:
        own = own.unionByName(table.filter("lo = 0 and hi = n").select("tree", "n", "digest"))
    return own


def _top_tree(roots: DataFrame, fanout: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The tree over the roots: ``key, lo, steps, root``, its leaves, and its inner nodes."""
    leaves = saved(_ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), ["key"]))
    nodes = _grow(leaves, fanout)
    tops = _roots(leaves, nodes).select("tree", "n", F.array().cast(STEPS).alias("steps"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    return _attach(leaves, nodes, tops, fanout, ["key"]).select("key", "lo", "steps", "root"), leaves, nodes


def _leaves(docs: DataFrame, columns: tuple[str, ...], id_col: str, tree_col: str, fanout: int, more: dict[str, Column]) -> DataFrame:
    narrow = docs.select(F.col(id_col).alias("id"), tree_key(F.col(tree_col)).alias("tree"), leaf([F.col(c) for c in columns]).alias("digest"), row_hash(docs).alias("row_key"), *[c.alias(k) for k, c in more.items()])
    table = saved(narrow)
    placed = saved(_ranked(table, ["id", "digest", "row_key"]))
    discard(table)
    return placed


def merkle_nodes(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", tree_col: str = "lang", fanout: int = 2) -> DataFrame:
    """The manifest: ``tree, level, lo, hi, digest``, a row for each node.

    ``tree`` is ``=`` and the value of ``tree_col``, or ``-`` for null; the tree on
    top is the empty string, its leaves the other trees' roots in their order. Two
    manifests that agree in a node agree in all rows below it, so their nodes'
    anti-join shows where tables differ. An empty table has no nodes.
    """
    leaves = _leaves(docs, columns, id_col, tree_col, fanout, {})
    nodes = _grow(leaves, fanout)
    _, top_leaves, top_nodes = _top_tree(_roots(leaves, nodes), fanout)
    out = None
    for table in (leaves.withColumn("level", F.lit(0)), *nodes, top_leaves.withColumn("level", F.lit(0)), *top_nodes):
        part = table.select("tree", "level", "lo", "hi", "digest")
        out = part if out is None else out.unionByName(part)
    return out


def merkle_proofs(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", tree_col: str = "lang", fanout: int = 2, more: dict[str, Column] | None = None) -> DataFrame:
    """``id_col, tree, lo, leaf, steps, subroot, root``, a row for each row, and the columns ``more``.

    ``steps``: from the leaf to the root on top, the digests of the siblings left
    and right of the path (each those of several, in order, for a larger
    ``fanout``; both empty for an only child). Leaves ascend by id, nulls first,
    then by digest; rows equal throughout are leaves side by side. Null columns
    count as ``-``, so a null text differs from an empty one. An empty table gives
    no rows. Other columns do not enter; ``tree_col`` null is a tree of its own.
    """
    more = more or {}
    leaves = _leaves(docs, columns, id_col, tree_col, fanout, {f"_m{i}": c for i, c in enumerate(more.values())})
    nodes = _grow(leaves, fanout)
    roots = saved(_roots(leaves, nodes))
    over, _, _ = _top_tree(roots, fanout)
    tops = saved(roots.join(over.withColumnRenamed("key", "tree").drop("lo"), "tree").select("tree", "n", "steps", F.col("digest").alias("subroot"), "root"))
    carried = ["id", *[f"_m{i}" for i in range(len(more))]]
    met = _attach(leaves, nodes, tops, fanout, carried)
    return met.select(F.col("id").alias(id_col), "tree", "lo", F.col("digest").alias("leaf"), "steps", "subroot", "root", *[F.col(f"_m{i}").alias(k) for i, k in enumerate(more)])


def fold(digest: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its way up amount to."""
    return F.aggregate(steps, digest, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def verify_manifest(proofs: DataFrame, docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id") -> DataFrame:
    """``id_col, verified`` for rows of ``docs``: true if a proof of the row's id leads from its present digest to the root.

    Rows without a proof are false; null ids meet the proofs of null ids.
    """
    now = docs.select(F.col(id_col).alias("id"), leaf([F.col(c) for c in columns]).alias("now"), F.monotonically_increasing_id().alias("row"))
    now = saved(now)
    held = now.join(proofs.select(F.col(id_col).alias("other"), "steps", "root"), F.col("id").eqNullSafe(F.col("other")), "left")
    good = F.coalesce(fold(F.col("now"), F.col("steps")) == F.col("root"), F.lit(False))
    return held.groupBy("row").agg(F.first("id").alias(id_col), F.max(good).alias("verified")).drop("row")


def manifest_table(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """The contract's digest of proofs, and their check against rows that were tampered with.

    Tampering adds 1 to ``n_chars`` where it is not null and the CRC of the id's
    decimal text is divisible by 7; null ids are left alone.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, F.lit(False))
    changed = leaf([F.col(c) if c != "n_chars" else F.col(c) + F.lit(1) for c in COLUMNS])
    proofs = merkle_proofs(docs, fanout=fanout, more={"now": F.when(hit & F.col("n_chars").isNotNull(), changed)})
    siblings = F.concat_ws("", F.transform("steps", lambda s: F.concat(s["left"], s["right"])))
    folded = fold(F.coalesce("now", "leaf"), F.col("steps"))
    out = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
