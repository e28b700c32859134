import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from histarium.llm import hmm
from histarium.llm.hmm import END, Lattice, Model, expected_counts, lexicon, log10_likelihoods, score_documents
from histarium.llm.words import words

SCHEMA = "doc_id long, text string"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def cases():
    rng = random.Random(8)
    tongues = [[f"{a}{b}" for a in x for b in "aeiou"] for x in ("btk", "mnl", "ÄSZ")]
    docs = [(i, " ".join(rng.choices(tongues[i % 3] + ["und"], k=rng.randrange(1, 60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "Neu " * 3000), (203, "ganz andere Worte"), (None, "ohne Nummer"), (5, docs[5][1]), (5, docs[5][1])]
    return docs


def random_model(states=3, symbols=5, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def paths(model, seq):
    """Probability of each state path with the sequence."""
    for path in product(range(len(model.start)), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for a, b, s in zip(path, path[1:], seq[1:], strict=False):
            p *= model.step[a, b] * model.emit[s, b]
        yield path, p


def test_recursions_equal_sums_over_all_paths():
    model, rng = random_model(), random.Random(2)
    seqs = [[rng.randrange(5) for _ in range(n)] for n in (1, 6, 3, 6, 2, 1, 4)]
    symbols, first = np.array(sum(seqs, [])), np.r_[0, np.cumsum([len(s) for s in seqs])]
    want = [math.log10(sum(p for _, p in paths(model, s))) for s in seqs]
    assert np.allclose(log10_likelihoods(model, symbols, first), want)
    sums = {"step": np.zeros((3, 3)), "start": np.zeros(3), "emit": np.zeros((5, 3))}
    expected_counts(model, symbols, first, sums)
    step, start, emit = np.zeros((3, 3)), np.zeros(3), np.zeros((5, 3))
    for s in seqs:
        whole = sum(p for _, p in paths(model, s))
        for path, p in paths(model, s):
            start[path[0]] += p / whole
            for a, b in zip(path, path[1:], strict=False):
                step[a, b] += p / whole
            for k, x in zip(path, s, strict=True):
                emit[x, k] += p / whole
    assert np.allclose(sums["step"], step) and np.allclose(sums["start"], start) and np.allclose(sums["emit"], emit)


def test_scores_equal_a_plain_computation(spark):
    docs = cases()
    df = spark.createDataFrame(docs, SCHEMA)
    got = score_documents(df, vocabulary=8, states=2, rounds=2)
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(t for d, x in docs if not out(d) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    # The same lexicon and model, but symbols, classes and recursions done word by word.
    train = df.filter(~hmm.held_out("doc_id"))
    lex = lexicon(hmm.count_words(train, "text", 8), 8)
    model = hmm.first_model(lex, 2)
    for _ in range(2):
        model = hmm.train_round(train, "text", lex, model)
    number = {None: int(END)}
    for word in {t for _, x in docs for t in tokens(x)} - {None}:
        number[word] = int(next(hmm.word_ids(w)[0] for _, _, w in words(pa.array([word]))))
    top = sorted(c, key=lambda t: (-c[t], np.uint64(number[t]).view(np.int64)))[:8]
    assert sorted(number[t] for t in top) == lex.ids.tolist()
    symbol = {t: i for i, t in enumerate(sorted(top, key=number.get))}
    kind = lambda t: number[t] % hmm.CLASSES
    rest = {k: (sum(c[t] for t in c if t not in symbol and kind(t) == k), sum(t not in symbol and kind(t) == k for t in c)) for k in range(hmm.CLASSES)}
    want = []
    for d, x in docs:
        base = likely = 0.0
        alpha = None
        for t in tokens(x):
            base += math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1)))
            s = symbol.get(t, 8 + kind(t))
            alpha = (model.start if alpha is None else alpha @ model.step) * model.emit[s]
            likely += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
            if t not in symbol:
                a, b = rest[kind(t)]
                likely += math.log10((c[t] + 0.5) / (a + 0.5 * (b + 1)))
        want.append((d, out(d), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, base, likely))
    want.sort(key=str)
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert np.allclose([r[5:] for r in rows], [w[5:] for w in want])


def test_training_helps_texts_left_out(spark):
    df = spark.createDataFrame(cases(), SCHEMA)
    r = score_documents(df, vocabulary=64, states=3, rounds=4).filter("held_out").selectExpr("sum(score) a", "sum(base_score) b").first()
    assert r.a > r.b


@pytest.mark.parametrize("rows", [[], [(1, "nur ein Text")]])
def test_tiny_tables(spark, rows):
    assert score_documents(spark.createDataFrame(rows, SCHEMA), rounds=1).count() == len(rows)


def test_lattice_keeps_every_word_once():
    first = np.array([0, 4, 5, 9, 11])
    lattice = Lattice(np.arange(11), first, np.array([0, 2, 3, 1]))
    assert sorted(lattice.symbols.tolist()) == list(range(11))


def test_extra_columns_and_wrong_ids(spark):
    docs = cases()
    plain = score_documents(spark.createDataFrame(docs, SCHEMA), vocabulary=8, states=2, rounds=1)
    more = spark.createDataFrame([(*d, 1, "x", 2.0) for d in docs], SCHEMA + ", id int, at string, score double")
    got = score_documents(more, vocabulary=8, states=2, rounds=1)
    assert got.columns == plain.columns
    assert sorted(str(r[:5]) for r in got.collect()) == sorted(str(r[:5]) for r in plain.collect())
    with pytest.raises(TypeError):
        score_documents(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_small_blocks_give_the_same_scores(spark, monkeypatch):
    df = spark.createDataFrame(cases(), SCHEMA)
    want = {str(r[0]): r for r in score_documents(df, vocabulary=8, states=2, rounds=1).collect()}
    monkeypatch.setattr(hmm, "BLOCK_WORDS", 100)
    monkeypatch.setattr(hmm, "BUCKET_WORDS", 20)
    for r in score_documents(df, vocabulary=8, states=2, rounds=1).collect():
        assert tuple(r[1:5]) == tuple(want[str(r[0])][1:5]) and np.allclose(r[5:], want[str(r[0])][5:])
