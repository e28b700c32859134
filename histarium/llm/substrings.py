"""Removal of passages that an earlier document has: repeated token windows.

Every window of ``width`` words gets a Rabin-Karp hash. Tasks hash a block of
documents at a time and send each distinct hash of a block once, with the
smallest document that has it, to the bucket of its value; windows that a
smaller document of the same block has need no sending. A bucket finds for each
hash the smallest document of all and returns the hashes of the others. Then
each document meets its own, and windows that recur merge into intervals.

A window of a million documents is sent once by each block, so no bucket grows
with one passage's copies. Rows carry hashes as packed bytes: a window costs
7 or 8 bytes and a small share of its document's id.
"""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, tasks, text_bytes, whole_id
from .words import U64, covered, mix, window_hashes, words

#: Words of a window. Fixed value of the data contract.
WIDTH = 13
#: Windows of a block; a block ends with the slice of text that reaches it.
BLOCK_WINDOWS = 1_000_000
#: Mean windows of a bucket and bytes of text of a group of documents: what one task holds at a time.
BUCKET_WINDOWS, GROUP_BYTES = 500_000, 8 << 20
#: Null ids count as larger than any other.
NO_ID = np.iinfo(np.int64).max


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers by their differences, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(values, prepend=values.dtype.type(0)).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64))


class _Buckets:
    """Equal ranges of the hash space; inside one, the low bytes tell a hash."""

    def __init__(self, n: int) -> None:
        self.n = min(max(256, n), 1 << 24)
        self.bytes = 8 - int(math.log2(self.n)) // 8

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> U64(32)) * U64(self.n)) >> U64(32)

    def low(self, hashes: np.ndarray) -> bytes:
        return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, : self.bytes]).tobytes()

    def full(self, bucket: int, data: bytes) -> np.ndarray:
        raw = np.zeros((len(data) // self.bytes, 8), np.uint8)
        raw[:, : self.bytes] = np.frombuffer(data, np.uint8).reshape(-1, self.bytes)
        low, size = raw.view(U64).reshape(-1), 1 << (8 * self.bytes)
        start = -((-bucket << 32) // self.n) << 32  # the bucket's first hash
        return low if self.bytes == 8 else U64(start) + ((low - U64(start % size)) & U64(size - 1))


def _group(ids: np.ndarray, n: int) -> np.ndarray:
    return (((mix(ids.view(U64)) >> U64(32)) * U64(n)) >> U64(32)).astype(np.int32)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


#: Rows on the way: ``at``, a group of documents, or -1 - bucket; what kind; ids; and hashes or places.
_SENT = "at int, kind int, ids binary, data binary"
_LOCAL, _GLOBAL, _TEXT = 0, 1, 2


def _sent(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    at, kind, ids, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(kind, pa.int32()), pa.array(ids, pa.binary()), pa.array(data, pa.binary())], names=["at", "kind", "ids", "data"])


def _cut(keys: np.ndarray) -> zip:
    """(key, first, after the last) of each stretch of sorted keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return zip(keys[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True) if len(keys) else zip([], [], [], strict=True)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and the text's hash, which tells texts of one id apart."""
    text = F.col(f"`{text_col}`")
    return docs.select(whole_id(docs, id_col), text, F.xxhash64(text))


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, width: int, n_buckets: int, n_groups: int, n_tasks: int, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``at, kind, ids, data``: for each group of documents, hashes of windows
    (``_GLOBAL``, one for each id) or first and last words of stretches
    (``_LOCAL``, for each id the text's hash, then two numbers) to remove."""
    buckets = _Buckets(n_buckets)

    def block(hashes, owners, places, ids, keys):
        """Rows for one block. owners: the text of each window; ids, keys: of each text."""
        rank = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[rank] = np.arange(len(ids))
        at = place[owners]
        order = np.argsort(hashes, kind="stable")
        order = order[np.lexsort((at[order], hashes[order]))] if len(ids) > 1 and (np.diff(at) < 0).any() else order
        h, doc = hashes[order], ids[owners[order]]
        new = np.r_[True, h[1:] != h[:-1]]
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        lost = order[doc > least]
        rows = []
        if len(lost):
            lost = np.sort(lost)
            owner, first = owners[lost], places[lost]
            begin = np.r_[True, (owner[1:] != owner[:-1]) | (first[1:] > first[:-1] + width)]
            a = np.flatnonzero(begin)
            b = np.r_[a[1:], len(lost)] - 1
            of, key, lo, hi = ids[owner[a]], keys[owner[a]], first[a], first[b] + width
            group = _group(of, n_groups)
            by = np.argsort(group, kind="stable")
            rows += [(k, _LOCAL, _pack(of[by[i:j]]), key[by[i:j]].tobytes() + _pack(np.c_[lo[by[i:j]], hi[by[i:j]]].ravel())) for k, i, j in _cut(group[by])]
        kept = np.sort(order[new])  # in the order of texts, so that ids pack well
        bucket = buckets.of(hashes[kept])
        by = np.argsort(bucket.astype(np.int32), kind="stable")
        kept, bucket = kept[by], bucket[by]
        ids_of, low = ids[owners[kept]], hashes[kept]
        rows += [(-1 - k, _GLOBAL, _pack(ids_of[i:j]), buckets.low(low[i:j])) for k, i, j in _cut(bucket.astype(np.int64))]
        return _sent(rows)

    def send(batches):
        held, size, n_texts = [], 0, 0
        for batch in batches:
            ids, keys = _ids(batch.column(0)), batch.column(2).to_numpy()
            for lo, hi, w in words(batch.column(1)):
                hashes, at = window_hashes(w.hashes(), w.first, width)
                owner = np.searchsorted(w.first, at, side="right") - 1
                held.append((hashes, owner + n_texts, at - w.first[owner], ids[lo:hi], keys[lo:hi]))
                size, n_texts = size + len(hashes), n_texts + hi - lo
                if size >= block_windows:
                    yield block(*map(np.concatenate, zip(*held, strict=True)))
                    held, size, n_texts = [], 0, 0
        if size:
            yield block(*map(np.concatenate, zip(*held, strict=True)))

    def settle(key, table):
        """A bucket's windows, or stretches already known, which pass through."""
        bucket = -1 - key[0].as_py()
        if bucket < 0:
            return table
        data, packed = table.column("data").to_pylist(), table.column("ids").to_pylist()
        hashes = np.concatenate([buckets.full(bucket, d) for d in data])
        ids = np.concatenate([_unpack(p) for p in packed])
        order = np.argsort(hashes, kind="stable")
        h = hashes[order]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        least = np.minimum.reduceat(ids[order], starts)
        lost = order[ids[order] > np.repeat(least, np.diff(np.r_[starts, len(h)]))]
        ids, hashes = ids[lost], hashes[lost]
        group = _group(ids, n_groups)
        by = np.lexsort((ids, group))
        ids, hashes, group = ids[by], hashes[by], group[by]
        return pa.Table.from_batches([_sent([(k, _GLOBAL, _pack(ids[i:j]), hashes[i:j].tobytes()) for k, i, j in _cut(group)])])

    found = _keyed(docs, id_col, text_col).mapInArrow(send, _SENT)
    return found.repartition(n_tasks, "at").groupBy("at").applyInArrow(settle, _SENT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep_text: bool = False) -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256`` (with ``keep_text``, ``kept_text`` too), a row for each document.

    A word goes if a window over it also starts in a document of smaller id.
    Null and empty texts have no words; texts shorter than a window stay; null
    ids count as larger than all; rows that share an id do not remove each
    other's words, and each loses only windows of its own text. Ids are
    whole numbers. An empty table gives no rows.
    """
    size = text_bytes(docs, text_col)
    n, n_tasks = partitions(docs.sparkSession), tasks(docs.sparkSession, size)
    n_groups = max(2 * n, size // GROUP_BYTES)
    lost = repeated_windows(docs, id_col, text_col, width, max(2 * n, size // 6 // BUCKET_WINDOWS), n_groups, n_tasks)

    def texts(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = _ids(batch.column(0))
            group, keys = _group(ids, n_groups), batch.column(2).to_numpy()
            values = batch.column(1)
            for i in range(batch.num_rows):
                if i % 256 == 0:
                    rows = []
                text = values[i].as_py()
                rows.append((int(group[i]), _TEXT, ids[i].tobytes() + keys[i].tobytes(), press.compress((text or "").encode())))
                if i % 256 == 255 or i == batch.num_rows - 1:
                    yield _sent(rows)

    def finish(table):
        kinds = table.column("kind").to_numpy()
        ids, data = table.column("ids"), table.column("data")
        local: dict[tuple[int, int], list[tuple[int, int]]] = {}
        hashed: dict[int, list[np.ndarray]] = {}
        for i in np.flatnonzero(kinds == _LOCAL):
            own, packed = _unpack(ids[int(i)].as_py()).tolist(), data[int(i)].as_py()
            keys, ends = np.frombuffer(packed[: 8 * len(own)], np.int64), _unpack(packed[8 * len(own) :])
            for doc, key, (a, b) in zip(own, keys.tolist(), ends.reshape(-1, 2).tolist(), strict=True):
                local.setdefault((doc, key), []).append((a, b))
        for i in np.flatnonzero(kinds == _GLOBAL):
            own, values = _unpack(ids[int(i)].as_py()), np.frombuffer(data[int(i)].as_py(), U64)
            for doc, a, b in _cut(own):
                hashed.setdefault(doc, []).append(values[a:b])
        unpress = zstandard.ZstdDecompressor()
        at = np.flatnonzero(kinds == _TEXT)
        out = []
        for lo in range(0, len(at), 512):
            own = [int(i) for i in at[lo : lo + 512]]
            keyed = [tuple(np.frombuffer(ids[i].as_py(), np.int64).tolist()) for i in own]
            doc_ids = [doc for doc, _ in keyed]
            column = pa.array([unpress.decompress(data[i].as_py()) for i in own], pa.binary())
            for a, b, w in words(column):
                hashes, places = window_hashes(w.hashes(), w.first, width) if any(d in hashed for d in doc_ids[a:b]) else (None, None)
                for t in range(b - a):
                    doc, first, end = doc_ids[a + t], w.first[t], w.first[t + 1]
                    n_words = int(end - first)
                    gone = None
                    if doc in hashed:
                        i, j = np.searchsorted(places, [first, end])
                        hit = places[i:j][np.isin(hashes[i:j], np.concatenate(hashed[doc]))] - first
                        gone = covered(n_words, hit, width)
                    if keyed[a + t] in local:
                        gone = np.zeros(n_words, bool) if gone is None else gone
                        for x, y in local[keyed[a + t]]:
                            gone[x:y] = True
                    tokens = column[a + t].as_py().split()
                    if gone is not None:
                        tokens = [x for x, g in zip(tokens, gone.tolist(), strict=True) if not g]
                    kept = b" ".join(tokens)
                    row = (None if doc == NO_ID else doc, n_words, n_words - len(tokens), sha256(kept).hexdigest())
                    out.append((*row, kept.decode()) if keep_text else row)
        names = [id_col, "n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * keep_text]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=names)

    shape = f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    rows = _keyed(docs, id_col, text_col).mapInArrow(texts, _SENT)
    return rows.unionByName(lost).repartition(n_tasks, "at").groupBy("at").applyInArrow(finish, shape)
