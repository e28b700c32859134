import random
import re
from hashlib import sha256

import numpy as np
import pytest

from histarium.llm import substrings
from histarium.llm.substrings import _Buckets, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, width=13):
    least = {}
    split = [(d, WORD.findall(t or "")) for d, t in docs]
    order = lambda d: float("inf") if d is None else d
    for d, w in split:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            least[k] = min(least.get(k, float("inf")), order(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < order(d):
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["é x", "日本"]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randrange(5, 60))) for _ in range(8)]
    docs = []
    for d in range(150):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(40)))]
        if d % 2:
            parts += [rng.choice(passages), " ".join(rng.choices(vocabulary, k=20)), rng.choice(passages)]
        docs.append((d, rng.choice([" ", "\n", "\x0b \t"]).join(parts)))
    docs += [(d, docs[7][1]) for d in range(200, 240)] + [(300, None), (301, ""), (302, "a " * 30), (303, "a " * 30000), (None, docs[9][1]), (5, docs[9][1]), (5, docs[9][1])]
    rng.shuffle(docs)
    return docs


def test_equals_brute_force(spark):
    docs = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in remove_repeats(df).collect()), key=str) == brute(docs)


def test_small_blocks_equal_brute_force(spark):
    docs = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    small = substrings.repeated_windows.__defaults__
    try:
        substrings.repeated_windows.__defaults__ = (1,)  # a block for each slice
        assert sorted((tuple(r) for r in remove_repeats(df).collect()), key=str) == brute(docs)
    finally:
        substrings.repeated_windows.__defaults__ = small


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hashes_survive_their_buckets():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 64, 5000, dtype=np.uint64)
    for n in (1, 256, 300, 65536, 70000, 1 << 24):
        b = _Buckets(n)
        of = b.of(h)
        for k in np.unique(of)[:50]:
            own = h[of == k]
            assert (b.full(int(k), b.low(own)) == own).all()


def test_extra_columns_and_wrong_ids(spark):
    docs = cases()
    df = spark.createDataFrame([(*d, 1, b"x", "y") for d in docs], "doc_id long, text string, kind int, ids binary, n_words string")
    assert sorted((tuple(r) for r in remove_repeats(df).collect()), key=str) == brute(docs)
    with pytest.raises(TypeError):
        remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_texts_under_one_id_lose_their_own_words_only(spark):
    w, other = " ".join(f"w{i}" for i in range(20)), " ".join(f"o{i}" for i in range(20))
    docs = [(1, w), (2, w), (2, other), (2, other + " " + w), (3, other), (None, w), (None, other)]
    for parts in (1, 5):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        assert sorted((tuple(r) for r in remove_repeats(df).collect()), key=str) == brute(docs)
