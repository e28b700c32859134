"""Hidden Markov language model: training by Baum-Welch on Spark, exact scoring.

The ``vocabulary`` most frequent words are symbols of their own; any other word
is the symbol of its class (a hash of its last two bytes), times the word's
probability within the class, (c + 0.5) / (N_class + 0.5 * (V_class + 1)), where
c may be 0. So every text has a probability, and the model that is broadcast,
(vocabulary + classes) * states numbers, has a fixed size.

Training passes over all texts of the training part: each task runs scaled
forward and backward recursions over its texts, many side by side, and adds up
expected counts; Spark sums those of all tasks by symbol, and the driver divides.

Word counts, of which there are as many as distinct words, stay distributed: in
the scoring pass, a block of texts sends each of its rarer words once to the
bucket of its hash, whatever its number of places, gets the counts back, and so
finishes base and model score. A bucket holds a range of hashes, so a word that
stands in all texts costs it one number for each block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, saved, tasks, text_bytes, whole_id
from .words import U64, Words, mix, words

#: Folds and smoothing. Fixed values of the data contract.
FOLDS, HELD_OUT, ADD = 5, 1, 0.5
STATES, VOCABULARY, CLASSES, ROUNDS = 8, 8192, 64, 4
#: Weight, in tokens, of the words' overall shares in each state's emissions; of the uniform in transitions.
PRIOR, PRIOR_STEP = 200.0, 1.0
#: Words of a block of texts; texts and words that go through the recursions side by side.
BLOCK_WORDS, SIDE_TEXTS, SIDE_WORDS = 2_000_000, 1024, 600_000
BUCKET_WORDS = 1_000_000
#: The end of a text, as a word.
END = U64(0x454E440000000000)


def word_ids(w: Words) -> np.ndarray:
    """Id of each word: 58 bits of its hash, and its class (of the last two bytes) in the low six."""
    last = w.data[w.ends - 1].astype(U64)
    second = np.where(w.ends - w.starts > 1, w.data[w.ends - 2], 0).astype(U64)
    kind = mix(last * U64(256) + second) & U64(CLASSES - 1)
    return (w.hashes() & ~U64(CLASSES - 1)) | kind


def with_ends(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words and ends, text after text, and where each text begins."""
    n = w.counts()
    first = np.r_[0, np.cumsum(n + 1)]
    ids = np.full(first[-1], END, U64)
    keep = np.ones(len(ids), bool)
    keep[first[1:] - 1] = False
    ids[keep] = word_ids(w)
    return ids, first


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    return (((ids >> U64(32)) * U64(n)) >> U64(32)).astype(np.int32)


def _stretches(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(keys):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        yield from zip(keys[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)


def _zip(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unzip(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def held_out(id_col: str) -> F.Column:
    """Whether a document is left out of training; null ids are not."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def count_words(train: DataFrame, text_col: str, n_buckets: int, n_tasks: int = 1) -> DataFrame:
    """``bucket, ids, counts``: sorted ids of a bucket's words, with their counts, packed."""

    def rows(ids, counts):
        bucket = bucket_of(ids, n_buckets)  # ids are sorted, so buckets are
        cut = list(_stretches(bucket))
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in cut], pa.int32()), pa.array([ids[a:b].tobytes() for _, a, b in cut], pa.binary()), pa.array([_zip(counts[a:b]) for _, a, b in cut], pa.binary())],
            names=["bucket", "ids", "counts"],
        )

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, w in words(batch.column(0), lower=True):
                ids, _ = with_ends(w)
                held.append(ids)
                size += len(ids)
                if size >= BLOCK_WORDS:
                    yield rows(*np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if size:
            yield rows(*np.unique(np.concatenate(held), return_counts=True))

    def add(table):
        ids = np.concatenate([np.frombuffer(x, U64) for x in table.column("ids").to_pylist()])
        counts = np.concatenate([_unzip(x, np.int64) for x in table.column("counts").to_pylist()])
        order = np.argsort(ids, kind="stable")
        ids, counts = ids[order], counts[order]
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        return pa.Table.from_batches([rows(ids[starts], np.add.reduceat(counts, starts))])

    shape = "bucket int, ids binary, counts binary"
    return train.select(text_col).mapInArrow(count, shape).repartition(max(n_tasks, partitions(train.sparkSession)), "bucket").groupBy("bucket").applyInArrow(add, shape)


@dataclass
class Lexicon:
    """Symbols: the frequent words, by sorted id, then the classes."""

    ids: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.ids, ids), max(len(self.ids) - 1, 0))
        kind = (ids & U64(CLASSES - 1)).astype(np.int64) + len(self.ids)
        return np.where(self.ids[at] == ids, at, kind) if len(self.ids) else kind

    def __len__(self) -> int:
        return len(self.ids) + CLASSES


def lexicon(counted: DataFrame, vocabulary: int) -> Lexicon:
    """Frequent words and totals. The driver gets ``vocabulary`` rows and one for each class."""

    def top(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.concatenate([np.frombuffer(x, U64) for x in batch.column("ids").to_pylist()])
            counts = np.concatenate([_unzip(x, np.int64) for x in batch.column("counts").to_pylist()])
            most = np.lexsort((ids, -counts))[:vocabulary]
            yield pa.RecordBatch.from_arrays([pa.array(ids[most].view(np.int64)), pa.array(counts[most])], names=["id", "n"])

    def totals(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.concatenate([np.frombuffer(x, U64) for x in batch.column("ids").to_pylist()])
            counts = np.concatenate([_unzip(x, np.int64) for x in batch.column("counts").to_pylist()])
            kind = (ids & U64(CLASSES - 1)).astype(np.int64)
            n = np.zeros(CLASSES, np.int64)
            np.add.at(n, kind, counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(np.bincount(kind, minlength=CLASSES))], names=["kind", "tokens", "words"])

    frequent = counted.mapInArrow(top, "id long, n long").orderBy(F.desc("n"), "id").limit(vocabulary).collect()
    by = {r.kind: r for r in counted.mapInArrow(totals, "kind long, tokens long, words long").groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()}
    ids = np.array([r.id for r in frequent], np.int64).view(U64)
    counts = np.array([r.n for r in frequent], np.int64)
    order = np.argsort(ids)
    ids, counts = ids[order], counts[order]
    tokens = np.array([by[k].tokens if k in by else 0 for k in range(CLASSES)], np.int64)
    distinct = np.array([by[k].words if k in by else 0 for k in range(CLASSES)], np.int64)
    total, n_distinct = int(tokens.sum()), int(distinct.sum())
    kind = (ids & U64(CLASSES - 1)).astype(np.int64)
    np.subtract.at(tokens, kind, counts)
    np.subtract.at(distinct, kind, 1)
    return Lexicon(ids, counts, total, n_distinct, tokens, distinct)


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # symbols x states


def first_model(lex: Lexicon, states: int) -> Model:
    """States differ at first by fixed pseudo-random factors of the emissions, and are sticky."""
    share = np.r_[lex.counts, lex.class_tokens + ADD].astype(float)
    noise = mix(np.arange(1, len(share) * states + 1, dtype=U64)).astype(float).reshape(-1, states) / 2.0**64
    emit = share[:, None] * (0.02 + noise**4)
    step = np.full((states, states), 0.05 / max(states - 1, 1))
    np.fill_diagonal(step, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(0))


def side_by_side(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of texts that go through the recursions together, longest first."""
    order = np.argsort(-lengths, kind="stable")
    lo = 0
    while lo < len(order):
        size = np.cumsum(lengths[order[lo : lo + SIDE_TEXTS]])
        n = max(1, int(np.searchsorted(size, SIDE_WORDS, side="right")))
        yield order[lo : lo + n]
        lo += n


class Lattice:
    """Symbols of some texts, longest first, place after place: at place t, those of
    the texts longer than t, so the texts of one place are the first of the place before."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, texts: np.ndarray) -> None:
        lengths = first[texts + 1] - first[texts]
        steps = int(lengths[0])
        self.active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), side="right")
        self.at = np.r_[0, np.cumsum(self.active)]
        place = np.repeat(np.arange(steps), self.active)
        self.text = np.arange(self.at[-1]) - self.at[place]
        self.symbols = symbols[first[texts][self.text] + place]
        self.previous = self.at[np.maximum(place - 1, 0)] + self.text

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward probabilities of each place and the scales, whose product is the likelihood."""
        alpha = model.emit[self.symbols]
        alpha[: self.active[0]] *= model.start
        scale = np.empty(len(alpha), alpha.dtype)
        for t in range(len(self.active)):
            a, b = self.at[t], self.at[t + 1]
            now = alpha[a:b]
            if t:
                before = self.at[t - 1]
                now *= alpha[before : before + b - a] @ model.step
            s = now.sum(1)
            scale[a:b] = s
            now /= s[:, None]
        return alpha, scale

    def backward(self, model: Model, scale: np.ndarray) -> np.ndarray:
        """Backward probabilities, each times emission over scale of its own place."""
        beta = model.emit[self.symbols]
        beta /= scale[:, None]
        back = np.ascontiguousarray(model.step.T)
        for t in range(len(self.active) - 2, -1, -1):
            a, n = self.at[t], self.active[t + 1]
            beta[a : a + n] *= beta[self.at[t + 1] : self.at[t + 1] + n] @ back
        return beta


def log10_likelihoods(model: Model, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1)
    for texts in side_by_side(np.diff(first)):
        lattice = Lattice(symbols, first, texts)
        _, scale = lattice.forward(model)
        out[texts] = np.bincount(lattice.text, np.log10(scale.astype(float)), minlength=len(texts))
    return out


def expected_counts(model: Model, symbols: np.ndarray, first: np.ndarray, sums: dict[str, np.ndarray]) -> None:
    """Adds the expected counts of some texts to ``sums``."""
    states = len(model.start)
    for texts in side_by_side(np.diff(first)):
        lattice = Lattice(symbols, first, texts)
        alpha, scale = lattice.forward(model)
        beta = lattice.backward(model, scale)
        later = slice(int(lattice.active[0]), None)
        sums["step"] += model.step * (alpha[lattice.previous[later]].T @ beta[later])
        # alpha * beta holds the emission twice: divide it out by way of the normalised product.
        alpha *= beta
        alpha /= model.emit[lattice.symbols]
        alpha /= alpha.sum(1)[:, None]
        sums["start"] += alpha[: lattice.active[0]].sum(0)
        for k in range(states):
            sums["emit"][:, k] += np.bincount(lattice.symbols, alpha[:, k], minlength=len(model.emit))


def train_round(train: DataFrame, text_col: str, lex: Lexicon, model: Model) -> Model:
    """One round of Baum-Welch over all training texts."""
    states = len(model.start)
    sent = train.sparkSession.sparkContext.broadcast((lex, model))
    names = [f"s{k}" for k in range(states)]

    def expect(batches):
        lex, model = sent.value
        model = Model(*(x.astype(np.float32) for x in (model.start, model.step, model.emit)))  # scaled, so single precision does to train
        sums = {"step": np.zeros((states, states)), "start": np.zeros(states), "emit": np.zeros((len(lex), states))}
        for batch in batches:
            for symbols, first in _symbol_blocks(batch.column(0), lex):
                expected_counts(model, symbols, first, sums)
        used = np.flatnonzero(sums["emit"].any(1))
        rows = np.concatenate([sums["emit"][used], sums["step"], sums["start"][None]])
        keys = np.concatenate([used, -1 - np.arange(states + 1)])  # -1 - k: transitions of k, then starts
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array(c) for c in rows.T.copy()]], names=["key", *names])

    added = train.select(text_col).mapInArrow(expect, "key long, " + ", ".join(f"{n} double" for n in names)).groupBy("key").agg(*[F.sum(n).alias(n) for n in names]).collect()
    emit, step, start = np.zeros((len(lex), states)), np.zeros((states, states)), np.zeros(states)
    for r in added:
        values = [r[n] for n in names]
        if r.key >= 0:
            emit[r.key] = values
        elif r.key >= -states:
            step[-1 - r.key] = values
        else:
            start[:] = values
    share = np.r_[lex.counts, lex.class_tokens + ADD].astype(float)
    share /= share.sum()
    emit = emit + PRIOR * share[:, None]
    step, start = step + PRIOR_STEP / states, start + PRIOR_STEP / states
    return Model(start / start.sum(), step / step.sum(1)[:, None], emit / emit.sum(0))


def _symbol_blocks(column: pa.Array, lex: Lexicon) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols of stretches of texts, large enough for many texts to go side by side."""
    held, size = [], 0

    def joined():
        lengths = np.concatenate([np.diff(f) for _, f in held])
        return np.concatenate([s for s, _ in held]), np.r_[0, np.cumsum(lengths)]

    for _, _, w in words(column, lower=True):
        ids, first = with_ends(w)
        held.append((lex.symbols(ids), first))
        size += len(ids)
        if size >= BLOCK_WORDS:
            yield joined()
            held, size = [], 0
    if size:
        yield joined()


#: Rows of the scoring pass: of a bucket or block, what kind, of which block, and packed numbers.
_ROW = "at int, kind int, block string, a binary, b binary, c binary"
_ASK, _COUNTS, _META = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 6
    types = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["at", "kind", "block", "a", "b", "c"])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``, a row for each row of ``docs``.

    Texts are lower-cased (ASCII); tokens are the words between white space and
    one end. ``base_score``: sum of log10((c + 0.5) / (N + 0.5 * (V + 1))).
    ``score``: log10 of the text's probability under the hidden Markov model.
    Ids are whole numbers. Null and empty texts are one end; rows with a null id are trained on;
    repeated rows are counted and scored each; without any training text all
    counts are 0. ``docs`` must give the same rows in the same order when a task
    is run again, as files and checkpoints do; a mismatch is an error, not a
    wrong score.
    """
    spark = docs.sparkSession
    size = text_bytes(docs, text_col)
    n_tasks, n_buckets = tasks(spark, size), max(2 * partitions(spark), size // 6 // BUCKET_WORDS)
    data = docs.select(whole_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"), held_out(id_col).alias("held_out"))
    train = data.filter(~F.col("held_out"))
    counted = saved(count_words(train, "text", n_buckets, n_tasks))
    lex = lexicon(counted, vocabulary)
    model = first_model(lex, states)
    for _ in range(rounds):
        model = train_round(train, "text", lex, model)
    return _score(data, counted, lex, model, n_buckets, n_tasks).withColumnRenamed("id", id_col)


def _score(data: DataFrame, counted: DataFrame, lex: Lexicon, model: Model, n_buckets: int, n_tasks: int) -> DataFrame:
    sent = data.sparkSession.sparkContext.broadcast((lex, model))
    n_groups = max(n_buckets, 1)

    def send(batches):
        lex, model = sent.value
        number, pid = 0, TaskContext.get().partitionId()
        known = np.log10(lex.counts + ADD)
        rest = np.log10(lex.class_tokens + ADD * (lex.class_words + 1))
        for batch in batches:
            held, size = [], 0
            ids_of = batch.column(0).cast(pa.int64())
            slices = list(words(batch.column(1), lower=True))
            for k, (lo, hi, w) in enumerate(slices):
                ids, first = with_ends(w)
                held.append((lo, hi, ids, first))
                size += len(ids)
                if size < BLOCK_WORDS and k < len(slices) - 1:
                    continue
                a, b = held[0][0], held[-1][1]
                ids = np.concatenate([h[2] for h in held])
                first = np.r_[0, np.cumsum(np.concatenate([np.diff(h[3]) for h in held]))]
                held, size = [], 0
                doc, out = ids_of.slice(a, b - a), batch.column(2).slice(a, b - a)
                symbols = lex.symbols(ids)
                likely = log10_likelihoods(model, symbols, first)
                text = np.repeat(np.arange(b - a), np.diff(first))
                rare = symbols >= len(lex.ids)
                base = np.bincount(text[~rare], known[symbols[~rare]], minlength=b - a)
                known_words = np.bincount(text[~rare], minlength=b - a)
                of_class = np.bincount(text[rare], rest[symbols[rare] - len(lex.ids)], minlength=b - a)
                meta = np.stack([np.diff(first), known_words, out.to_numpy(zero_copy_only=False).astype(np.int64), (~np.asarray(doc.is_null())).astype(np.int64), doc.fill_null(0).to_numpy(zero_copy_only=False)])
                check = zlib.crc32(meta.tobytes())
                block = f"{pid}-{number}-{check}"
                number += 1
                own, which = np.unique(ids[rare], return_inverse=True)
                text = text[rare]
                places = np.r_[len(own), len(text), np.diff(text, prepend=0), which].astype(np.int32)
                asked = [(-1 - k, _ASK, block, own[i:j].tobytes(), b"", b"") for k, i, j in _stretches(bucket_of(own, n_buckets))]
                yield _rows([(zlib.crc32(block.encode()) % n_groups, _META, block, _zip(meta), np.stack([base, likely, of_class]).tobytes(), _zip(places)), *asked])

    def answer(key, table):
        bucket = -1 - key[0].as_py()
        if bucket < 0:
            return table
        kinds, a, b = table.column("kind").to_pylist(), table.column("a"), table.column("b")
        own = [i for i, k in enumerate(kinds) if k == _COUNTS]
        ids = np.frombuffer(a[own[0]].as_py(), U64) if own else np.zeros(0, U64)
        counts = _unzip(b[own[0]].as_py(), np.int64) if own else np.zeros(0, np.int64)
        out = []
        for i, (kind, block) in enumerate(zip(kinds, table.column("block").to_pylist(), strict=True)):
            if kind != _ASK:
                continue
            asked = np.frombuffer(a[i].as_py(), U64)
            found = np.zeros(len(asked), np.int64)
            if len(ids):
                at = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
                found = np.where(ids[at] == asked, counts[at], 0)
            out.append((zlib.crc32(block.encode()) % n_groups, _ASK, block, _zip(found), np.array([bucket], np.int64).tobytes(), b""))
        return pa.Table.from_batches([_rows(out)])

    lex_total, base_unit = lex.total, float(np.log10(lex.total + ADD * (lex.distinct + 1)))

    def finish(table):
        rows: dict[str, list[int]] = {}
        for i, block in enumerate(table.column("block").to_pylist()):
            rows.setdefault(block, []).append(i)
        kinds, a, b, c = table.column("kind").to_pylist(), table.column("a"), table.column("b"), table.column("c")
        parts = []
        for block, own in rows.items():
            heads = [i for i in own if kinds[i] == _META]
            if len(heads) != 1:
                raise RuntimeError(f"block {block} came {len(heads)} times: the input changed between runs of a task")
            n_tokens, n_known, out, has_id, doc = _unzip(a[heads[0]].as_py(), np.int64).reshape(5, -1)
            base, likely, of_class = np.frombuffer(b[heads[0]].as_py()).reshape(3, -1)
            asked = sorted((int(np.frombuffer(b[i].as_py(), np.int64)[0]), i) for i in own if kinds[i] == _ASK)
            counts = np.concatenate([np.zeros(0, np.int64), *[_unzip(a[i].as_py(), np.int64) for _, i in asked]])
            places = _unzip(c[heads[0]].as_py(), np.int32)
            if len(counts) != places[0]:
                raise RuntimeError(f"block {block} misses counts: the input changed between runs of a task")
            text, which = np.cumsum(places[2 : 2 + places[1]]), places[2 + places[1] :]
            rare = np.bincount(text, np.log10(counts + ADD)[which], minlength=len(base))
            n_known = n_known + np.bincount(text[counts[which] > 0], minlength=len(base))
            parts.append(
                pa.Table.from_arrays(
                    [pa.array(doc, mask=has_id == 0), pa.array(out != 0), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(doc), lex_total)), pa.array(base + rare - n_tokens * base_unit), pa.array(likely + rare - of_class)],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        return pa.concat_tables(parts)

    told = counted.select((-1 - F.col("bucket")).alias("at"), F.lit(_COUNTS).alias("kind"), F.lit("").alias("block"), F.col("ids").alias("a"), F.col("counts").alias("b"), F.lit(b"").alias("c"))
    answered = data.mapInArrow(send, _ROW).unionByName(told).repartition(n_tasks, "at").groupBy("at").applyInArrow(answer, _ROW)
    shape = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answered.repartition(n_tasks, "at").groupBy("at").applyInArrow(finish, shape)
