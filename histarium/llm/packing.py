"""Token ids packed into fixed-length rows by best-fit decreasing.

Texts become token ids with one end token each. Documents longer than a row are
split into full rows and a rest. The pieces of a pool, longest first, each go to
the open row with the least room that holds them; a segment tree over capacities
finds that room in as many steps as the row length has bits. A task packs its
own documents pool by pool: nothing is shuffled and memory is bounded by a pool.

Which documents share a row, and the numbers of rows, therefore follow from how
the input is dealt into partitions; what each document's pieces are does not.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_id
from .words import Words, buffers

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenizer of that vocabulary, and its free id, which ends a text. Fixed values.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
LENGTH, POOL_TOKENS = 2048, 4_000_000
#: Stretches whose ids a worker remembers, and bytes of text encoded at a time.
REMEMBERED, SLICE_BYTES = 1_000_000, 1 << 22

#: No pre-token goes from a visible character to white space after it, so texts whose only white
#: space is spaces and line feeds can be encoded in stretches, [ \n]*[^ \n]+ or [ \n]+ at the end.
OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
#: Bytes that such other white space begins with: control characters, and leads of non-ASCII spaces.
SUSPECT = np.zeros(256, bool)
SUSPECT[[*range(0x09, 0x0A), *range(0x0B, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """Ids of texts. Stretches are told apart by 64-bit hashes and lengths, each is
    encoded once, and the ids of a slice of texts are then gathered with numpy."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.encode_ordinary = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.width = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.width[list(ranks.values())] = [len(t) for t in ranks]
        self._forget()

    def _forget(self) -> None:
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, keys: np.ndarray, stretches: list[bytes]) -> None:
        # Stretches from white space to a visible character do not mix when they follow each
        # other, so they are encoded in one call and told apart by the bytes of their tokens.
        joint = np.array([s[0] in b" \n" and s[-1] not in b" \n" for s in stretches])
        new: list[np.ndarray] = []
        tokens = np.array(self.encode_ordinary(b"".join([s for s, j in zip(stretches, joint.tolist(), strict=True) if j]).decode()), np.int32)
        size = np.cumsum([len(s) for s, j in zip(stretches, joint.tolist(), strict=True) if j])
        ends = np.searchsorted(np.cumsum(self.width[tokens]), size) + 1 if len(size) else size
        n = np.zeros(len(keys), np.int64)
        n[joint] = np.diff(ends, prepend=0)
        for i in np.flatnonzero(~joint).tolist():
            new.append(np.array(self.encode_ordinary(stretches[i].decode()), np.int32))
            n[i] = len(new[-1])
        order = np.r_[np.flatnonzero(joint), np.flatnonzero(~joint)]  # as their tokens stand
        self.ids = np.concatenate([self.ids, tokens, *new])
        at = np.r_[self.at, len(self.first) - 1 + np.arange(len(keys))]
        self.first = np.r_[self.first, self.first[-1] + np.cumsum(n[order])]
        known = np.r_[self.known, keys[order]]
        by = np.argsort(known, kind="stable")
        self.known, self.at = known[by], at[by]

    def _numbers(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Place in ``first`` of each stretch; those met for the first time are encoded."""
        distinct, one, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if len(self.known) + new.sum() > REMEMBERED:
            self._forget()
            new[:] = True
        if new.any():
            self._learn(distinct[new], [data[starts[i] : ends[i]].tobytes() for i in one[new].tolist()])
        return self.at[np.searchsorted(self.known, distinct)][inverse]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; the bytes of all are handled at once."""
        edges = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        odd = np.diff(np.r_[0, np.cumsum(SUSPECT[np.frombuffer(b"".join(texts), np.uint8)])][edges])
        whole = {i: np.array(self.encode_ordinary(texts[i].decode()), np.int32) for i in np.flatnonzero(odd).tolist() if OTHER_SPACE.search(texts[i].decode())}
        plain = iter(self._encode([t for i, t in enumerate(texts) if i not in whole]))
        return [whole[i] if i in whole else next(plain) for i in range(len(texts))]

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return [np.zeros(0, np.int32)] * len(texts)
        edges = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        white = (data == 0x20) | (data == 0x0A)
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = white[1:] & ~white[:-1]
        begins[edges] = True
        starts = np.flatnonzero(begins[:-1])
        ends, first = np.r_[starts[1:], len(data)], np.searchsorted(starts, edges)
        # With the length in the key, a clash needs equal hashes of equally long stretches.
        keys = Words(data, starts, ends, first).hashes() ^ (ends - starts).astype(np.uint64)
        number = self._numbers(keys, starts, ends, data)
        n = np.diff(self.first)[number]
        upto = np.r_[0, np.cumsum(n)]
        ids = self.ids[np.repeat(self.first[number] - upto[:-1], n) + np.arange(upto[-1])]
        return [ids[a:b] for a, b in zip(upto[first[:-1]], upto[first[1:]], strict=True)]

    def slices(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column, in order; nulls count as empty."""
        data, offsets = buffers(column)
        lo, n = 0, len(offsets) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1)
            yield from self.encode([data[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi)])
            lo = hi


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: The encoder of this worker, by vocabulary: later tasks go on with what earlier ones taught it.
_kept: dict[str, Encoder] = {}


def _encoder(name: str, ranks) -> Encoder:
    if name not in _kept:
        _kept.clear()
        _kept[name] = Encoder(ranks.value)
    return _kept[name]


class Capacities:
    """Open rows by the room they have left; the least room that suffices is found by descent."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the tightest row with at least ``need`` room, which is taken out."""
        at = self.size + need
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not self.count[at]:
                    at += 1
        room = at - self.size
        self._change(room, -1)
        return room, self.rows[room].pop()

    def _change(self, room: int, by: int) -> None:
        at = self.size + room
        while at:
            self.count[at] += by
            at >>= 1


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; each row's sizes sum to at most ``length``."""
    rows: list[list[int]] = []
    open_rows = Capacities(length)
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = open_rows.take(sizes[piece])
        room, row = found or (length, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(piece)
        if room > sizes[piece]:
            open_rows.add(room - sizes[piece], row)
    return rows


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", end: int = END, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """A row for each packed row: ``pack_id, ids, n_tokens, doc_ids, offsets, cu_seqlens, resets``.

    ``ids``: ``length`` little-endian numbers of 2 bytes (4 where the vocabulary
    needs them), filled up with the end token. ``doc_ids`` and ``offsets``: for
    each segment its document and which of that document's tokens it begins
    with. ``cu_seqlens``: where segments begin, and where the last ends.
    ``resets``: places at which positions start from 0 again, the filling
    included. Every document has its end token, so null and empty texts have
    one token; ids are whole numbers; null ids stay null; repeated rows are
    packed each; an empty table gives no rows. The ranks of the tokenizer are read on the driver and
    broadcast; their number is fixed.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))
    name = sha256(repr(sorted(ranks.value.items())).encode()).hexdigest()
    width = np.dtype("<u2" if max(end, *ranks.value.values()) < 1 << 16 else "<u4")

    def pack(batches):
        encoder, number, pid = _encoder(name, ranks), 0, TaskContext.get().partitionId()
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def packed():
            nonlocal number
            out = {k: [] for k in ("pack_id", "ids", "n_tokens", "doc_ids", "offsets", "cu_seqlens", "resets")}
            for row in best_fit_decreasing([len(p[2]) for p in pieces], length):
                ids, at = np.full(length, end, width), [0]
                for i in row:
                    tokens = pieces[i][2]
                    ids[at[-1] : at[-1] + len(tokens)] = tokens
                    at.append(at[-1] + len(tokens))
                out["pack_id"].append(f"{pid}-{number}")
                out["ids"].append(ids.tobytes())
                out["n_tokens"].append(at[-1])
                out["doc_ids"].append([pieces[i][0] for i in row])
                out["offsets"].append([pieces[i][1] for i in row])
                out["cu_seqlens"].append(at)
                out["resets"].append(at if at[-1] < length else at[:-1])
                number += 1
            types = [pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), types, strict=True)], names=list(out))

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.slices(batch.column(1)), strict=True):
                tokens = np.append(ids, end).astype(width)
                pieces += [(doc, i, tokens[i : i + length]) for i in range(0, len(tokens), length)]
                held += len(tokens)
                if held >= pool_tokens:
                    yield packed()
                    pieces, held = [], 0
        if pieces:
            yield packed()

    shape = "pack_id string, ids binary, n_tokens int, doc_ids array<long>, offsets array<long>, cu_seqlens array<int>, resets array<int>"
    return docs.select(whole_id(docs, id_col), F.col(f"`{text_col}`")).mapInArrow(pack, shape)


def write_packs(docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes the packed rows as Parquet, ``ids`` as plain bytes, and returns the table."""
    pack_documents(docs, **options).write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    return docs.sparkSession.read.parquet(path)


def id_matrix(rows: list, width: str = "<u2") -> np.ndarray:
    """The packed rows as one matrix of ids."""
    return np.stack([np.frombuffer(r.ids, width) for r in rows])


def position_ids(resets: list[int], length: int = LENGTH) -> np.ndarray:
    """Positions of a row's tokens: 0 at each reset, then counting."""
    start = np.zeros(length, np.int64)
    start[resets] = resets
    return np.arange(length) - np.maximum.accumulate(start)
