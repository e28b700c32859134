"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages. Each passage is encoded: shares of pairs of
character classes, of hashed words and of repeated words, then a dense layer with
tanh. A gated attention weighs a document's passages, and a logistic layer scores
their weighted mean; labels of documents alone teach all layers.

Training runs on a bounded sample of labelled documents, whose encoded bags are a
table: each step sends the parameters, of fixed size, to the tasks, and adds up
the gradients that they return. Scoring reads every text whole, a bounded number
of passages at a time, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved
from .words import Words, words

#: Words of a passage; passages encoded at a time.
PASSAGE, CHUNK = 64, 1024
#: Documents to learn from, at most, and passages of one of them.
SAMPLE_DOCS, BAG = 8192, 4096
HIDDEN, GATE, STEPS, RATE, DECAY = 24, 12, 40, 0.03, 1e-3
#: Partitions of the bags, and passages of one of their rows.
BAG_PARTITIONS, ROW_PASSAGES = 16, 2048
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
N_WORDS = 256
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", ".", ",;:", "!?", "\"'`", "()[]{}", "-_/\\", "|<>", "#*$%&@^~+=")
N_CLASSES = 16
#: Lengths in words, distinct words, words like the one before, capitals within words, mean length.
N_SHAPES = 5
N_FEATURES = N_CLASSES * N_CLASSES + N_WORDS + N_SHAPES
_CLASS = np.full(256, len(_CLASSES), np.int64)  # what is left of ASCII
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars.encode())] = _i
_CLASS[0x80:0xC0], _CLASS[0xC0:] = len(_CLASSES) + 1, len(_CLASSES) + 2


def encode(own: Words, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, features) of passages, ``CHUNK`` of them at a time, in order; ``first``: word counts before each text."""
    counts = np.diff(first)
    passages = -(-counts // PASSAGE)
    text = np.repeat(np.arange(len(counts)), passages)
    number = np.arange(len(text)) - np.repeat(np.cumsum(passages) - passages, passages)
    begin = first[text] + number * PASSAGE
    end = np.minimum(begin + PASSAGE, first[text + 1])
    for a in range(0, len(text), CHUNK):
        b = min(a + CHUNK, len(text))
        yield text[a:b], _features(own, begin[a:b], end[a:b])


def _features(own: Words, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Features of passages that follow each other, each the words ``begin`` to ``end``."""
    n, size = len(begin), end - begin
    passage = np.repeat(np.arange(n), size)
    word = np.arange(begin[0], end[-1])
    # Bytes from a passage's first word to the end of its last.
    at, upto = own.starts[begin], own.ends[end - 1]
    length = upto - at
    place = np.repeat(at - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
    of, kind = np.repeat(np.arange(n), length), _CLASS[own.data[place]]
    inside = of[1:] == of[:-1]
    pair = (of[1:] * N_CLASSES + kind[:-1])[inside] * N_CLASSES + kind[1:][inside]
    pairs = np.bincount(pair, minlength=n * N_CLASSES**2).reshape(n, -1) / np.maximum(length - 1, 1)[:, None]
    own_hash = Words(own.data[at[0] : upto[-1]], own.starts[word] - at[0], own.ends[word] - at[0], np.zeros(1, np.int64)).hashes()
    bags = np.bincount(passage * N_WORDS + (own_hash >> np.uint64(20) & np.uint64(N_WORDS - 1)).astype(np.int64), minlength=n * N_WORDS).reshape(n, -1) / size[:, None]
    order = np.lexsort((own_hash, passage))
    new = np.r_[True, (own_hash[order][1:] != own_hash[order][:-1]) | (passage[order][1:] != passage[order][:-1])]
    distinct = np.bincount(passage[order], weights=new, minlength=n) / size
    again = np.bincount(passage[1:], weights=(own_hash[1:] == own_hash[:-1]) & (passage[1:] == passage[:-1]), minlength=n) / size
    capitals = pairs[:, 0] + pairs[:, N_CLASSES]  # a capital behind a capital or a small letter
    mean = np.bincount(passage, weights=own.ends[word] - own.starts[word], minlength=n) / size
    shapes = np.stack([np.log2(1 + size) / 6, distinct, again, np.sqrt(capitals), np.log2(1 + mean) / 6], axis=1)
    return np.concatenate([np.sqrt(pairs), np.sqrt(bags), shapes], axis=1).astype(np.float32)


@dataclass
class Model:
    """Parameters by name: ``mean, scale`` of features, and ``W, b, V, p, U, q, w, c, d``."""

    values: dict[str, np.ndarray]

    def layers(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        v = self.values
        h = np.tanh((x - v["mean"]) * v["scale"] @ v["W"] + v["b"])
        t, g = np.tanh(h @ v["V"] + v["p"]), 1 / (1 + np.exp(-(h @ v["U"] + v["q"])))
        return h, t, g, (t * g) @ v["w"]


LEARNED = ("W", "b", "V", "p", "U", "q", "w", "c", "d")


def start(mean: np.ndarray, scale: np.ndarray, share: float, seed: int = 7) -> Model:
    """A model before training, which scores all with ``share``; the same for the same ``seed``."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    share = min(max(share, 0.01), 0.99)
    return Model({"mean": mean, "scale": scale, "W": draw(len(mean), HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "p": np.zeros(GATE), "U": draw(HIDDEN, GATE), "q": np.zeros(GATE), "w": draw(GATE), "c": np.zeros(HIDDEN), "d": np.array(np.log(share / (1 - share)))})


def gradients(model: Model, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Sums over bags of the log loss and of its gradients; ``first``: where each bag's passages begin. No bag is empty."""
    v = model.values
    bag = np.repeat(np.arange(len(labels)), np.diff(np.r_[first, len(x)]))
    scaled = (x - v["mean"]) * v["scale"]
    h, t, g, logit = model.layers(x)
    e = np.exp(logit - np.maximum.reduceat(logit, first)[bag])
    a = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first)
    s = z @ v["c"] + v["d"]
    loss = float(np.logaddexp(0, s).sum() - (labels * s).sum())
    ds = 1 / (1 + np.exp(-s)) - labels
    dz = ds[:, None] * v["c"]
    da = (dz[bag] * h).sum(1)
    dlogit = a * (da - np.add.reduceat(a * da, first)[bag])
    dt, dg = dlogit[:, None] * g * v["w"] * (1 - t * t), dlogit[:, None] * t * v["w"] * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ v["V"].T + dg @ v["U"].T) * (1 - h * h)
    return loss, {"W": scaled.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "p": dt.sum(0), "U": h.T @ dg, "q": dg.sum(0), "w": (t * g).T @ dlogit, "c": z.T @ ds, "d": np.array(ds.sum())}


def in_fold(docs: DataFrame, id_col: str, fold: int = HELD_OUT) -> Column:
    """Whether the CRC of the id's text leaves ``fold``; null ids do not."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % FOLDS == fold, F.lit(False))


def _bags(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(text, its passages' features); a text without words is one passage of zeros."""
    for lo, hi, own in words(texts):
        parts: dict[int, list[np.ndarray]] = {}
        for text, x in encode(own, own.first):
            for t in np.unique(text).tolist():
                parts.setdefault(t, []).append(x[text == t])
        for t in range(hi - lo):
            yield lo + t, np.concatenate(parts[t]) if t in parts else np.zeros((1, N_FEATURES), np.float32)


def sample_bags(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_docs: int) -> DataFrame:
    """``x, sizes, labels``: rows of several bags each, features as 16-bit floats.

    Of the ids with a label, the ``sample_docs`` that come first by a hash teach;
    several labels of an id count as their mean. Texts of over ``BAG`` passages do
    not teach, though they are scored.
    """
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~in_fold(labels, id_col)).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(sample_docs)  # bounded by the parameter
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "label")

    def pack(batches):
        held: list[tuple[np.ndarray, float]] = []

        def row():
            x = np.concatenate([b for b, _ in held]).astype(np.float16)
            sizes, label = np.array([len(b) for b, _ in held], np.int64), np.array([v for _, v in held])
            held.clear()
            return pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in (("x", x), ("sizes", sizes), ("labels", label))})

        for batch in batches:
            label = batch.column("label").to_numpy()
            for i, bag in _bags(batch.column("text")):
                if len(bag) <= BAG:
                    held.append((bag, float(label[i])))
                if sum(len(b) for b, _ in held) >= ROW_PASSAGES:
                    yield row()
        if held:
            yield row()

    return known.mapInArrow(pack, "x binary, sizes binary, labels binary").repartition(BAG_PARTITIONS)


def _rows(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, where bags begin, labels) of each row of bags."""
    for batch in batches:
        for x, sizes, labels in zip(*(batch.column(c).to_pylist() for c in ("x", "sizes", "labels")), strict=True):
            size = np.frombuffer(sizes, np.int64)
            yield np.frombuffer(x, np.float16).reshape(-1, N_FEATURES).astype(np.float32), np.cumsum(size) - size, np.frombuffer(labels)


def _summed(bags: DataFrame, of) -> list[np.ndarray]:
    """Sums over all rows of bags of the arrays that ``of`` makes of one; each task adds up its own."""

    def run(batches):
        total = None
        for row in _rows(batches):
            found = of(*row)
            total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"a": pa.array([np.asarray(a, np.float64).tobytes() for a in total], pa.binary()), "i": pa.array(range(len(total)), pa.int32())})

    sums: dict[int, np.ndarray] = {}
    for r in bags.mapInArrow(run, "a binary, i int").collect():  # BAG_PARTITIONS rows of fixed size for each
        sums[r.i] = sums.get(r.i, 0) + np.frombuffer(r.a)
    return [sums[i] for i in sorted(sums)]


def train(bags: DataFrame, steps: int = STEPS) -> Model:
    """A model fitted to saved rows of bags by Adam on whole gradients; without bags, one that scores all with a half."""
    sums = _summed(bags, lambda x, first, labels: [np.array([len(labels), labels.sum(), len(x)], float), x.sum(0, dtype=np.float64), np.square(x, dtype=np.float64).sum(0)])
    if not sums:
        return start(np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.5)
    (n, positive, passages), mean = sums[0], sums[1] / sums[0][2]
    spread = np.sqrt(np.maximum(sums[2] / passages - mean * mean, 0))
    model = start(mean, 1 / np.maximum(spread, 0.02), positive / n)
    moments = {k: (np.zeros_like(model.values[k]), np.zeros_like(model.values[k])) for k in LEARNED}
    for step in range(1, steps + 1):
        found = _summed(bags, lambda x, first, labels, m=model: list(gradients(m, x, first, labels)[1].values()))
        values = dict(model.values)
        for k, total in zip(LEARNED, found, strict=True):
            slope = total.reshape(values[k].shape) / n + (DECAY * values[k] if k in "WVUc" else 0)
            one, two = (0.9 * moments[k][0] + 0.1 * slope, 0.999 * moments[k][1] + 0.001 * slope * slope)
            moments[k] = one, two
            values[k] = values[k] - RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
        model = Model(values)
    return model


def bag_scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Scores of texts: passages are weighed as they come, with a running maximum, so that a text's length takes no memory."""
    v = {k: np.asarray(a, np.float32) for k, a in model.values.items()}
    small = Model(v)
    out = np.zeros(len(texts))
    for lo, hi, own in words(texts):
        n = hi - lo
        most, weight, sums = np.full(n, -np.inf), np.zeros(n), np.zeros((n, len(v["b"])))

        def add(text: np.ndarray, x: np.ndarray, most=most, weight=weight, sums=sums) -> None:
            h, _, _, logit = small.layers(x)
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            at, size = text[first], np.diff(np.r_[first, len(text)])
            now = np.maximum(most[at], np.maximum.reduceat(logit, first))
            keep, e = np.exp(most[at] - now), np.exp(logit - np.repeat(now, size))
            weight[at] = weight[at] * keep + np.add.reduceat(e, first)
            sums[at] = sums[at] * keep[:, None] + np.add.reduceat(e[:, None] * h, first)
            most[at] = now

        for text, x in encode(own, own.first):
            add(text, x)
        empty = np.flatnonzero(np.diff(own.first) == 0)
        if len(empty):
            add(empty, np.zeros((len(empty), N_FEATURES), np.float32))
        out[lo:hi] = 1 / (1 + np.exp(-(sums / weight[:, None] @ model.values["c"] + model.values["d"])))
    return out


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, held_out, score, predicted``, a row for each document.

    Learns from labelled documents whose id's CRC modulo 5 is not 0 (see
    ``sample_bags`` for the bound), and scores all. Only the text enters a score:
    equal texts score alike. Null text counts as empty; texts without words score
    as one empty passage; rows with null ids are scored and teach nothing; without
    any label all scores are a half. An empty table gives no rows. Other columns
    play no part.
    """
    bags = saved(sample_bags(docs, labels, id_col, text_col, label_col, sample_docs))
    model = train(bags)

    def run(batches):
        for batch in batches:
            score = bag_scores(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), in_fold(docs, id_col).alias("held_out"), F.col(text_col).alias("text"))
    shape = T.StructType([rows.schema["id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, shape).withColumnRenamed("id", id_col)
