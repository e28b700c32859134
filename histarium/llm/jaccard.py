"""N-gram Jaccard join by MinHash banding, with exact checks.

1. Each text becomes its set of five-word shingles (hashed to 64 bits), a
   MinHash signature and its band hashes. Texts with equal sets are one node,
   whatever their ids: ids only name classes at the end.
2. Rows and bands are chosen for a target recall at the threshold. Band hashes
   are shuffled; in each bucket the members are tied to its smallest and its
   largest node. Ties whose signatures differ by far more than chance allows are
   dropped. Where a bucket's other members then are in several groups, the
   signatures of all of them are compared, in pairs of blocks. What stays
   connected is a candidate group.
3. In a candidate group all pairs are checked on the full shingle sets. A
   group larger than a block is cut into blocks, and pairs of blocks are the
   units, so no task holds a group of unbounded size. Of its members only what
   they differ by from the group's core, the shingles that most members have,
   is sent to the units: for sets a, b and the core c,
   |a & b| = |c| - |c - a| - |c - b| + |(a ^ c) & (b ^ c)|. A text is read once,
   and near copies are short. Units return each member's number of links and a
   spanning forest, not the pairs.
4. Classes are the components of the checked links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from .common import free_name, partitions, saved, whole_id
from .words import U64, mix, window_hashes, words

#: Fixed values of the contract for near duplicates.
SHINGLE, THRESHOLD = 5, 0.8
RECALL, MAX_HASHES = 0.9999, 192
#: Ties are dropped when the estimated similarity is so many standard deviations below the threshold.
SIGMAS = 5
#: Members and shingles of a block, and of a unit with small groups.
BLOCK, BLOCK_SHINGLES, UNIT = 1024, 2_000_000, 1024
#: Members of a bucket in a block, and rows of a unit, when their signatures are compared.
MET, MET_ROWS = 1024, 1 << 15
#: A shingle of so many sets of a unit goes into a matrix product, with so many others at a time; a rarer one is counted by its pairs.
COMMON, COLUMNS = 48, 4096


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): most rows, so fewest false candidates, that find a pair at
    the threshold with probability ``recall`` within ``max_hashes`` hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        miss = math.log1p(-(threshold**rows))
        bands = math.ceil(math.log1p(-recall) / miss)
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=U64))
    return (seed[:n] >> U64(32)).astype(np.uint32) | np.uint32(1), (seed[n:] >> U64(32)).astype(np.uint32)


def shingle_sets(column: pa.Array, width: int):
    """For each slice of texts: (first, after the last, distinct shingles of all, where each text's begin).

    A text of fewer words than ``width`` has one shingle, all its words.
    """
    for lo, hi, w in words(column):
        h = w.hashes()
        grams, at = window_hashes(h, w.first, width)
        begin = np.searchsorted(at, w.first)
        own = []
        for t in range(hi - lo):
            if begin[t + 1] > begin[t]:
                own.append(np.unique(grams[begin[t] : begin[t + 1]]))
            else:
                few = h[w.first[t] : w.first[t + 1]]
                own.append(mix(np.array([int(np.bitwise_xor.reduce(mix(few + np.arange(len(few), dtype=U64))))], U64)) if len(few) else few)
        yield lo, hi, np.concatenate(own), np.r_[0, np.cumsum([len(o) for o in own])]


def set_sums(grams: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each set, 64 bits each; those of an empty set are 0."""
    full = np.flatnonzero(np.diff(first))
    sums = [np.zeros(len(first) - 1, U64) for _ in range(2)]
    if len(full):
        for s, salt in zip(sums, (1, 2), strict=True):
            s[full] = np.add.reduceat(mix(grams ^ U64(salt)), first[:-1][full])
    return sums


def nameless(s1: str = "s1") -> F.Column:
    """A negative number from a set's hash, for a class that no id can name: equal to an id only by the chance of 63-bit hashes."""
    return -F.shiftrightunsigned(s1, 1) - 1


def text_key(text_col: str) -> F.Column:
    """A hash of the text, which with the id finds a row's text again; null has one of its own."""
    return F.xxhash64(F.col(f"`{text_col}`"))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """``id, th`` (hash of the text), ``s1, s2`` (128 bits of the shingle set), ``n`` (its size), ``bands`` (8 bytes each), ``sig`` (a byte for each hash)."""
    k = bands * rows
    a, b = _multipliers(k)

    def sign(batches):
        for batch in batches:
            for lo, hi, grams, first in shingle_sets(batch.column(1), width):
                n = np.diff(first)
                full = np.flatnonzero(n)
                heads = first[:-1][full]
                sums = set_sums(grams, first)
                least = np.zeros((hi - lo, k), np.uint32)
                if len(full):
                    x = (grams >> U64(16)).astype(np.uint32)
                    own = np.empty_like(x)
                    for i in range(k):
                        np.multiply(x, a[i], out=own)
                        own ^= b[i]
                        least[full, i] = np.minimum.reduceat(own, heads)
                band = np.zeros((hi - lo, bands), U64)
                for r in range(rows):
                    band = mix(band ^ least[:, r * bands : (r + 1) * bands].astype(U64)) + np.arange(bands, dtype=U64)
                low = (mix(least.astype(U64)) & U64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(2).slice(lo, hi - lo),
                        *[pa.array(s.view(np.int64)) for s in sums],
                        pa.array(n, pa.int64()),
                        pa.array([x.tobytes() if m else b"" for x, m in zip(band, n, strict=True)], pa.binary()),
                        pa.array([x.tobytes() if m else b"" for x, m in zip(low, n, strict=True)], pa.binary()),
                    ],
                    names=["id", "th", "s1", "s2", "n", "bands", "sig"],
                )

    return docs.select(whole_id(docs, id_col), F.col(f"`{text_col}`"), text_key(text_col)).mapInArrow(sign, "id long, th long, s1 long, s2 long, n long, bands binary, sig binary")


def _alike(sig: np.ndarray, least: float) -> np.ndarray:
    """True for each two rows of bytes that agree in at least ``least`` places."""
    if len(sig) <= 64:
        return (sig[:, None] == sig[None]).sum(2) >= least
    columns, out = np.ascontiguousarray(sig.T), np.empty((len(sig), len(sig)), bool)
    for lo in range(0, len(sig), 128):
        same = np.zeros((len(sig[lo : lo + 128]), len(sig)), np.uint8 if len(columns) < 256 else np.uint32)
        for c in columns:
            same += c[lo : lo + 128, None] == c[None]
        out[lo : lo + 128] = same >= least
    return out


def candidate_groups(nodes: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    """``node, component`` of nodes that share buckets with similar ones. nodes: ``node, bands, sig``.

    Members of a bucket meet its smallest and its largest node. Buckets in which the
    others are then in several groups are compared in full, so any two similar
    nodes of a bucket are in one group.
    """
    k = bands * rows

    def spread(batches):
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands))], names=["h", "node"])

    member = nodes.filter("length(bands) > 0").select("node", "bands").mapInArrow(spread, "h long, node long")
    bucket = member.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    met = saved(member.join(bucket, "h"))
    tied = met.select("node", F.explode(F.array("lo", "hi")).alias("other")).filter("node != other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    sig = saved(nodes.select("node", "sig"))  # as a table: a node with many ties is then a key that Spark can split
    pair = tied.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    slack = SIGMAS * math.sqrt(threshold * (1 - threshold) / k)
    least = k * ((threshold - slack) * (1 - 1 / 256) + 1 / 256)  # unequal hashes share a byte by chance

    def near(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, k) for c in ("sig_a", "sig_b"))
                keep = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    first = saved(connected_components(pair.mapInArrow(near, "a long, b long"), "a", "b"))
    more = _rest_of_buckets(met, first, sig, k, least)
    if more.isEmpty():
        return first
    now = saved(connected_components(more, "a", "b").toDF("component", "now"))
    alone = now.select(F.col("component").alias("node"), F.col("now").alias("component")).join(first, "node", "left_anti")
    return first.join(now, "component", "left").select("node", F.coalesce("now", "component").alias("component")).unionByName(alone)


def _rest_of_buckets(met: DataFrame, first: DataFrame, sig: DataFrame, k: int, least: float) -> DataFrame:
    """``a, b``: groups of ``first`` (a node in none is its own) that similar nodes of a bucket tie.

    met: ``h, node, lo, hi``. Of buckets whose members other than lo and hi, which all
    have met, are in several groups, blocks meet in pairs, many small buckets to a unit.
    """
    between = met.filter("node != lo and node != hi").select("h", "node")
    own = between.join(first, "node", "left").select("h", "node", F.coalesce("component", "node").alias("c"))
    apart = own.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).filter("c0 < c1")
    dealt = own.join(apart.select("h", F.ceil(F.col("n") / MET).cast("long").alias("blocks")), "h").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with")
    asked = saved(dealt.select("h", "node", "c", "block", every).select("h", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "c"))
    units = max(partitions(met.sparkSession), asked.count() // MET_ROWS)

    def check(table):
        h, i, j, c = (table.column(n).to_numpy() for n in ("h", "i", "j", "c"))
        order = np.lexsort((c, j, i, h))
        new = np.flatnonzero(np.r_[True, (np.diff(h[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)])
        x = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, k)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in np.split(order, new[1:]):
            if c[rows[0]] != c[rows[-1]]:
                root = c[rows][_tied(_alike(x[rows], least))]
                differ = root != c[rows]
                a.append(root[differ])
                b.append(c[rows][differ])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    unit = F.pmod(F.xxhash64("h", "i", "j"), F.lit(units)).alias("unit")
    found = asked.join(sig, "node").select(unit, "h", "i", "j", "c", "sig").groupBy("unit").applyInArrow(check, "a long, b long")
    return saved(found.distinct())


def _shared(grams: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """Number of grams that each two of ``size`` sets share; ``of``: the set of each gram."""
    order = np.argsort(grams, kind="stable")
    grams, of = grams[order], of[order]
    begin = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
    count = np.diff(np.r_[begin, len(grams)])
    column = np.repeat(np.arange(len(count)), count)
    shared = np.zeros((size, size), np.float32)
    rare, flat, held = (count > 1) & (count < COMMON), [], 0
    use = rare[column]
    own, group = of[use], column[use]
    for step in range(1, int(count[rare].max(initial=1))):
        same = np.flatnonzero(group[step:] == group[:-step])
        flat.append(np.minimum(own[same], own[same + step]) * size + np.maximum(own[same], own[same + step]))
        held += len(same)
        if held > 1 << 24 or step == int(count[rare].max(initial=1)) - 1:
            shared += np.bincount(np.concatenate(flat), minlength=size * size).reshape(size, size)
            flat, held = [], 0
    shared += shared.T
    use = (count >= COMMON)[column]
    own, group = of[use], (np.cumsum(count >= COMMON) - 1)[column[use]]
    for lo in range(0, int((count >= COMMON).sum()), COLUMNS):
        i, j = np.searchsorted(group, [lo, lo + COLUMNS])
        m = np.zeros((size, COLUMNS), np.float32)
        m[own[i:j], group[i:j] - lo] = 1
        shared += m @ m.T
    return shared


def _links(own: list[np.ndarray], threshold: float, n: np.ndarray | None = None, lacks: np.ndarray | None = None, core: int = 0) -> np.ndarray:
    """True for each pair of sets whose Jaccard similarity is at least ``threshold``.

    With ``core``, the size of the group's core, ``own`` are the differences from
    it, ``n`` the sizes of the sets and ``lacks`` what they lack of the core.
    """
    size = np.array([len(s) for s in own], np.int64)
    shared = _shared(np.concatenate(own), np.repeat(np.arange(len(own)), size), len(own))
    np.fill_diagonal(shared, size)
    n, lacks = (size, np.zeros(len(own), np.int64)) if n is None else (n, lacks)
    shared += (core - lacks[:, None] - lacks[None, :]).astype(np.float32)
    both = n[:, None] + n[None, :] - shared
    return (shared >= threshold * both - 1e-6) & (both > 0)


def _tied(links: np.ndarray) -> np.ndarray:
    """The first row that each row is linked to, directly or not."""
    root = np.arange(len(links))
    while True:
        least = np.minimum(root, np.where(links, root[None, :], len(links)).min(axis=1))
        least = least[least]
        if (least == root).all():
            return root
        root = least


#: Bits of the filter of texts for each text that is sought, and in all, 16 MB; a fuller filter lets more texts pass for nothing.
FILTER_BITS, MOST_BITS, PIECE = 16, 1 << 27, 1 << 15


def _compressed(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``id, th, z`` of those of ``id, th, text`` that may be among ``wanted`` (``n`` of ``id, th``).

    A bitmap of hashed keys, of bounded size, spares the others the way to the join.
    """
    bits = min(MOST_BITS, -(-FILTER_BITS * max(n, 1) // PIECE) * PIECE)
    place = F.pmod(F.xxhash64("th", "id"), F.lit(bits))
    pieces = wanted.select(place.alias("p")).groupBy(F.expr(f"p div {PIECE}").alias("piece")).agg(F.bitmap_construct_agg(F.col("p") % PIECE).alias("map"))
    held = np.zeros((bits // PIECE, PIECE // 8), np.uint8)
    for r in pieces.collect():  # MOST_BITS at most
        held[r.piece] = np.frombuffer(r.map, np.uint8)
    sent = texts.sparkSession.sparkContext.broadcast(held.ravel())

    def compress(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            at = batch.column(3).to_numpy()
            batch = batch.filter(pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([z.compress((t or "").encode()) for t in part.column(2).to_pylist()], pa.binary())], names=["id", "th", "z"])

    return texts.select("id", "th", "text", place.alias("place")).mapInArrow(compress, "id long, th long, z binary")


def _sets(z: list[bytes], width: int) -> list[np.ndarray]:
    unpress = zstandard.ZstdDecompressor()
    column = pa.array([unpress.decompress(x) for x in z], pa.binary())
    return [grams[a:b] for _, _, grams, first in shingle_sets(column, width) for a, b in zip(first[:-1], first[1:], strict=True)]


_LINKS = "node long, other long, links long"


def _told(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    parts = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 3
    return pa.Table.from_arrays([pa.array(p, pa.int64()) for p in parts], names=["node", "other", "links"])


def _in_small(held: DataFrame, units: int, width: int, threshold: float) -> DataFrame:
    """Links in groups of one block, many groups to a unit."""

    def check(table):
        at: dict[int, list[int]] = {}
        for row, component in enumerate(table.column("component").to_pylist()):
            at.setdefault(component, []).append(row)
        node, copies, z = table.column("node").to_numpy(), table.column("copies").to_numpy(), table.column("z")
        found = []
        for rows in at.values():
            rows = np.array(rows)[np.argsort(node[rows])]
            if len(rows) > 1:
                links = _links(_sets([z[int(r)].as_py() for r in rows], width), threshold)
                np.fill_diagonal(links, False)
                found.append((node[rows], node[rows][_tied(links)], links @ copies[rows]))
        return _told(found)

    unit = F.pmod(F.xxhash64("component"), F.lit(units)).alias("unit")
    return held.select(unit, "component", "node", "copies", "z").groupBy("unit").applyInArrow(check, _LINKS)


def _in_large(held: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links in groups of several blocks, a pair of blocks to a unit. held: ``component, size, blocks, block, node, copies, z``."""

    def count(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                own = _sets(part.column("z").to_pylist(), width)
                grams, of = np.concatenate(own), np.repeat(part.column("component").to_numpy(), [len(s) for s in own])
                order = np.lexsort((grams, of))
                grams, of = grams[order], of[order]
                begin = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])]) if len(grams) else np.zeros(0, np.int64)
                n = np.diff(np.r_[begin, len(grams)])
                sizes = dict(zip(part.column("component").to_pylist(), zip(part.column("size").to_pylist(), part.column("blocks").to_pylist(), strict=True), strict=True))
                size, blocks = np.array([sizes[c] for c in of[begin].tolist()], np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(of[begin]), pa.array(size), pa.array(blocks), pa.array(grams[begin].view(np.int64)), pa.array(n)], names=["component", "size", "blocks", "gram", "n"])

    counted = held.select("component", "size", "blocks", "z").mapInArrow(count, "component long, size long, blocks long, gram long, n long")
    core = counted.groupBy("component", "size", "blocks", "gram").agg(F.sum("n").alias("n")).filter("2 * n > size")
    core = saved(core.select("component", "blocks", "gram"))
    cores = core.select("component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "gram")

    def differ(members, core):
        names = ["component", "blocks", "block", "core", "rows", "grams"]
        if not members.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, [pa.int64()] * 4 + [pa.binary()] * 2, strict=True)})
        common = np.sort(core.column("gram").to_numpy()).view(np.uint64)
        common.sort()
        rows, grams = [], []
        for node, copies, own in zip(members.column("node").to_pylist(), members.column("copies").to_pylist(), _sets(members.column("z").to_pylist(), width), strict=True):
            apart = np.setxor1d(own, common, assume_unique=True)
            lacks = (len(common) - len(own) + len(apart)) // 2
            rows.append((node, copies, len(own), lacks, len(apart)))
            grams.append(apart)
        first = [members.column(n)[0].as_py() for n in ("component", "blocks", "block")]
        values = [*first, len(common), np.array(rows, np.int64).tobytes(), np.concatenate(grams).tobytes()]
        return pa.table({n: pa.array([v], t) for n, v, t in zip(names, values, [pa.int64()] * 4 + [pa.binary()] * 2, strict=True)})

    by = ["component", "block"]
    blocks = held.groupBy(*by).cogroup(cores.groupBy(*by)).applyInArrow(differ, "component long, blocks long, block long, core long, rows binary, grams binary")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = saved(blocks).withColumn("with", every).select("component", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "core", "rows", "grams")

    def check(table):
        rows = [np.frombuffer(r.as_py(), np.int64).reshape(-1, 5) for r in table.column("rows")]
        block = np.repeat(table.column("block").to_numpy(), [len(r) for r in rows])
        grams = [g for r, x in zip(rows, table.column("grams"), strict=True) for g in np.split(np.frombuffer(x.as_py(), np.uint64), np.cumsum(r[:, 4])[:-1])]
        row = np.concatenate(rows)
        order = np.argsort(row[:, 0])
        row, block, grams = row[order], block[order], [grams[i] for i in order]
        node, copies, n, lacks, _ = row.T
        links = _links(grams, threshold, n, lacks, table.column("core")[0].as_py())
        np.fill_diagonal(links, False)
        root = _tied(links)
        if table.num_rows > 1:  # pairs inside a block are counted where it meets itself
            links &= block[:, None] != block[None, :]
        return _told([(node, node[root], links @ copies)])

    return pairs.groupBy("component", "i", "j").applyInArrow(check, _LINKS)


def checked_links(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float) -> DataFrame:
    """``node, other, links``: a row for each member and unit, tied to the smallest
    node it is linked to in that unit, directly or not, and its weighted number of links there.

    members: ``node, component, copies, n``, and ``of``, id and text key of a row with the node's set.
    """
    size = members.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("grams"))
    total = members.agg(F.count("*").alias("rows"), F.sum("n").alias("grams")).first()
    units = max(partitions(docs.sparkSession), total["rows"] // UNIT, (total["grams"] or 0) // (2 * BLOCK_SHINGLES))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("grams") / BLOCK_SHINGLES)).cast("long")
    # The wrapped key makes both sides plain exchanges, so that Spark can split that of a large group.
    sized = members.withColumn("k", F.struct("component")).join(size.select(F.struct("component").alias("k"), "size", blocks.alias("blocks")), "k").drop("k")
    # A table, so that Spark broadcasts it while it is small and shuffles no text then.
    dealt = saved(sized.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))))
    texts = _compressed(docs.select(whole_id(docs, id_col).alias("id"), text_key(text_col).alias("th"), F.col(f"`{text_col}`").alias("text")), dealt.select("of.id", "of.th"), total["rows"])
    found = dealt.join(texts, (F.col("of.th") == F.col("th")) & F.col("of.id").eqNullSafe(F.col("id"))).drop("of", "id", "th")
    held = saved(found.dropDuplicates(["node"]))
    small = _in_small(held.filter("blocks = 1"), units, width, threshold)
    large = held.filter("blocks > 1")
    return small if large.isEmpty() else small.unionByName(_in_large(large, width, threshold))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, width: int, recall: float) -> DataFrame:
    """``id, th, s1, s2, n, class_id, least, n_links`` for each row; ``least``: the smallest id of its class, null if none has one."""
    bands, rows = choose_bands(threshold, recall)
    signed = saved(signatures(docs, id_col, text_col, width, bands, rows))
    sets = signed.groupBy("s1", "s2").agg(F.min("id").alias("least"), F.min(F.struct("th", "id")).alias("of"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    node = saved(sets.withColumn("node", F.monotonically_increasing_id()))  # numbers hold from here on, as they are written
    one = node.filter("n > 0")
    group = candidate_groups(one.select("node", "bands", "sig"), bands, rows, threshold)
    members = saved(group.join(one.select("node", "of", "copies", "n"), "node"))
    checked = saved(checked_links(members, docs, id_col, text_col, width, threshold))
    classes = saved(connected_components(checked.filter("node != other"), "node", "other"))
    own = node.select("node", "s1", "s2", "least", "copies").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    held = saved(own.groupBy("class").agg(F.min("least").alias("least"), F.min(F.struct("s1", "s2")).alias("set")))
    # An id of several texts may be the smallest of several classes: the first by its set is called by it.
    first = held.filter("least is not null").groupBy("least").agg(F.min(F.struct("set.s1", "set.s2", "class"))["class"].alias("class"))
    named = held.join(first.select("class", F.lit(True).alias("first")), "class", "left").select("class", "least", F.when(F.col("first"), F.col("least")).otherwise(nameless("set.s1")).alias("class_id"))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    told = own.select("s1", "s2", "node", "class", "copies").join(links, "node", "left").join(named, "class")
    told = told.select("s1", "s2", "class_id", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("id", "th", "s1", "s2", "n").join(told, ["s1", "s2"])


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """``id_col, class_id, n_links, n_shingles``, a row for each row of ``docs``.

    ``class_id``: the smallest id of the documents connected by links, that is
    pairs with Jaccard similarity of at least ``threshold`` between their sets
    of ``width``-word shingles. ``n_links``: the other documents a document is
    linked to, copies each counted. Words stand between white space and are
    taken as they are. Shorter texts have one shingle, all their words; texts
    without words, null or empty, have equal (empty) sets, so are copies of each
    other. Rows that share an id are told apart by their texts, each with links and
    a class of its own; of several classes with one smallest id, the first by a hash
    of its sets is called by it, the others have negative numbers made from 63-bit
    hashes of a set. Ids are whole numbers, and may be negative. Rows with a null
    id are linked as others are; a class of such rows alone has such a negative
    number, too. An empty table gives no rows.
    """
    told = _classes(docs, id_col, text_col, threshold, width, recall)
    return told.select(F.col("id").alias(id_col), "class_id", "n_links", F.col("n").alias("n_shingles"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """The document with the smallest id of each class, columns as they were.

    A row with a null id stays only if no row of its class has an id. Of rows
    of one class that share the kept id, or have no id, one stays.
    """
    rows = _classes(docs, id_col, text_col, threshold, width, recall).filter(F.col("id").eqNullSafe(F.col("least")))
    texts = rows.groupBy("class_id", "s1", "s2", "th", "id").agg(F.count("*").alias("rows"))
    kept = saved(texts.groupBy("class_id").agg(F.min(F.struct("s1", "s2", "th", "id", "rows")).alias("k")).select("k.th", "k.id", "k.rows"))
    key, th, own_key, own_th = (free_name(docs, n) for n in ("_kept_id", "_kept_th", "_own_id", "_own_th"))
    keyed, kept = docs.withColumns({own_key: whole_id(docs, id_col), own_th: text_key(text_col)}), kept.toDF(th, key, "rows")
    same = (F.col(th) == F.col(own_th)) & F.col(key).eqNullSafe(F.col(own_key))
    # Kept ids are about as many as documents: one way for all sizes, not a broadcast for small ones.
    out = keyed.join(kept.filter("rows = 1").hint("merge"), same, "left_semi").drop(own_key, own_th)
    several = kept.filter("rows > 1")
    if several.isEmpty():
        return out
    return out.unionByName(keyed.join(several, same, "left_semi").dropDuplicates([own_key, own_th]).drop(own_key, own_th))
