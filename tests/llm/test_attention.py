import random
import zlib

import numpy as np
import pyarrow as pa

from histarium.llm import attention
from histarium.llm.attention import LEARNED, N_FEATURES, Model, bag_scores, encode, gradients, score_quality, start
from histarium.llm.words import words


def some_model(seed=5):
    rng = np.random.default_rng(seed)
    model = start(rng.normal(size=N_FEATURES) * 0.1, np.ones(N_FEATURES), 0.6)
    return Model(model.values | {"c": rng.normal(size=attention.HIDDEN), "q": rng.normal(size=attention.GATE)})


def bags(texts):
    return [x for _, x in attention._bags(pa.array(texts, pa.string()))]


def plain_score(model, x):
    """One bag by the formulas as they are written down."""
    v = model.values
    h = [np.tanh(((row - v["mean"]) * v["scale"]) @ v["W"] + v["b"]) for row in x]
    a = np.array([v["w"] @ (np.tanh(v["V"].T @ k + v["p"]) / (1 + np.exp(-(v["U"].T @ k + v["q"])))) for k in h])
    a = np.exp(a) / np.exp(a).sum()
    return 1 / (1 + np.exp(-(sum(w * k for w, k in zip(a, h, strict=True)) @ v["c"] + v["d"])))


TEXTS = ["One short text.", "", None, " \n ", "word " * 64, "word " * 65, "The The The end of it\n" * 40, "日本 " * 200 + "été", "x" * 5000, "a | b | c " * 700]


def test_scores_equal_the_formulas(monkeypatch):
    model = some_model()
    want = [plain_score(model, x.astype(float)) for x in bags(TEXTS)]
    assert [len(x) for x in bags(TEXTS)] == [1, 1, 1, 1, 1, 2, 4, 4, 1, 55]
    for chunk in (1024, 7):
        monkeypatch.setattr(attention, "CHUNK", chunk)
        assert np.allclose(bag_scores(model, pa.array(TEXTS, pa.string())), want, atol=1e-5)


def test_features_of_a_passage(monkeypatch):
    monkeypatch.setattr(attention, "CHUNK", 3)
    (_, _, own) = next(words(pa.array(["Ab ab ab. C\nd", "", "12 12"])))
    found = list(encode(own, own.first))
    x = np.concatenate([f for _, f in found])
    assert np.concatenate([t for t, _ in found]).tolist() == [0, 2]
    shapes = x[:, -attention.N_SHAPES :]
    assert np.allclose(shapes[:, 1], [4.5 / 5 + 0.1, 0.5], atol=0.01) and np.allclose(shapes[:, 2], [0, 0.5])
    pairs = x[0, : attention.N_CLASSES**2].reshape(attention.N_CLASSES, -1) ** 2
    assert np.isclose(pairs.sum(), 1, atol=1e-5) and np.isclose(pairs[0, 1], 1 / 12, atol=1e-5)  # "Ab"


def test_gradients_equal_differences():
    model, rng = some_model(), np.random.default_rng(2)
    x = rng.normal(size=(9, N_FEATURES)) * 0.3
    first, labels = np.array([0, 1, 5]), np.array([1.0, 0.0, 0.5])
    _, found = gradients(model, x, first, labels)
    for k in LEARNED:
        flat = np.asarray(model.values[k]).ravel()
        for i in rng.choice(flat.size, min(4, flat.size), replace=False):
            moved = []
            for d in (1e-5, -1e-5):
                values = flat.copy()
                values[i] += d
                moved.append(gradients(Model(model.values | {k: values.reshape(np.shape(model.values[k]))}), x, first, labels)[0])
            assert np.isclose((moved[0] - moved[1]) / 2e-5, np.ravel(found[k])[i], rtol=1e-3, atol=1e-6), k


def corpus(n=400, seed=4):
    """Documents whose label hangs on one passage among clean ones."""
    rng = random.Random(seed)
    clean = lambda k: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(k))
    junk = lambda k: " ".join(f"{w.upper()} ||" for w in clean(k).split())
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.4
        parts = [clean(rng.randrange(20, 100)) for _ in range(rng.randrange(1, 5))]
        if bad:
            parts.insert(rng.randrange(len(parts) + 1), junk(40))
        docs.append((i, "\n".join(parts), "en", "s"))
        labels.append((i, int(not bad)))
    return docs, labels


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus()
    extra = [(5000, None, "x", "s"), (5001, "", None, None), (None, docs[0][1], "x", "s"), (0, docs[0][1], "zz", "other")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame([*labels, (None, 1), (7, None), (99999, 1)], "doc_id long, quality int")
    got = score_quality(df, marks).collect()
    assert len(got) == len(docs) + len(extra)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by_id[i].held_out for i, _ in held) and not any(by_id[i].held_out for i, _ in labels if zlib.crc32(str(i).encode()) % 5)
    assert sum(by_id[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert by_id[5000].score == by_id[5001].score
    assert len({round(r.score, 9) for r in got if r.doc_id in (0, None)}) == 1
    # labels of the held-out fold play no part
    other = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in score_quality(df, other).collect()}
    assert all(abs(again[i] - by_id[i].score) < 1e-6 for i, _ in labels)


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in score_quality(docs, none).collect()] == [0.5, 0.5]
    assert score_quality(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in score_quality(docs, one).collect())


def test_long_texts_are_read_whole():
    model = some_model()
    text = " ".join(f"w{i % 977}" for i in range(200_000)) + " | | | END"
    assert np.isclose(bag_scores(model, pa.array([text]))[0], plain_score(model, bags([text])[0].astype(float)), atol=1e-4)
