import random
import re

import numpy as np
import pytest

from histarium.llm import jaccard
from histarium.llm.jaccard import _links, choose_bands, jaccard_classes, keep_one

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    ids = [d for d, _ in docs]
    s = [sets(t) for _, t in docs]
    near = [[a != b and (s[a] == s[b] or len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])) for b in range(len(s))] for a in range(len(s))]
    root = list(range(len(s)))
    for _ in s:
        new = [min([root[a], *(root[b] for b in range(len(s)) if near[a][b])], key=lambda r: ids[r]) for a in range(len(s))]
        if new == root:
            break
        root = new
    return sorted((ids[a], ids[root[a]], sum(near[a]), len(s[a])) for a in range(len(s)))


def cases(groups=6, size=12):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    docs, d = [], 0
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randrange(30, 120))
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 9])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append((d, " ".join(w)))
            d += 1
    docs += [(d + i, " ".join(rng.choices(vocabulary, k=rng.randrange(12)))) for i in range(20)]
    docs += [(500, None), (501, ""), (502, "a b"), (503, "b a"), (504, "a\tb"), (505, "x " * 30000)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("block", [256, 4])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = cases()
    got = jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute(docs)


def test_one_of_each_class_stays_with_its_columns(spark):
    docs = cases()
    want = {c for _, c, _, _ in brute(docs)}
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, node string, _kept_id int")
    got = keep_one(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_null_ids_repeated_rows_and_empty_table(spark):
    schema = "doc_id long, text string"
    long = " ".join(f"v{i}" for i in range(40))
    rows = [(None, long), (7, long), (7, long), (None, "q r s t u v"), (None, "q r s t u v")]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert [g for g in got if g[1] == 7] == [(7, 7, 2), (7, 7, 2), (None, 7, 2)]
    assert [g[2] for g in got if g[1] < 0] == [1, 1]
    assert jaccard_classes(spark.createDataFrame([], schema)).count() == 0


def test_bands_reach_the_recall():
    b, r = choose_bands(0.8, 0.9999, 192)
    assert b * r <= 192 and 1 - (1 - 0.8**r) ** b >= 0.9999


def test_links_are_exact():
    rng = np.random.default_rng(2)
    own = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (5, 20, 40, 60, 61, 62, 90, 200, 200)]
    got = _links(own, 0.8)
    for a, x in enumerate(own):
        for b, y in enumerate(own):
            assert got[a, b] == (len(np.intersect1d(x, y)) * 5 >= len(np.union1d(x, y)) * 4)


def test_negative_ids_equal_brute_force(spark):
    docs = [(3 * d - 60, t) for d, t in cases()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_classes(df).collect()) == brute(docs)
    assert sorted(r.doc_id for r in keep_one(df).collect()) == sorted({c for _, c, _, _ in brute(docs)})


def test_null_ids_are_linked_and_one_row_of_a_class_stays(spark):
    base = [[f"{g}{i}" for i in range(60)] for g in "abc"]
    near = lambda g, i: " ".join([*base[g][:i], "new", *base[g][i + 1 :]])
    same = " ".join(base[0])
    rows = [(None, near(0, 59)), (-9, same), (-9, same), (-4, near(0, 0)), (None, same)]
    rows += [(None, near(1, 0)), (None, near(1, 59)), (None, near(1, 0)), (None, "x y"), (None, "x y"), (None, None), (None, ""), (5, near(2, 0)), (6, near(2, 59))]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, _kept_s1 int")
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(df).collect()]
    assert sorted((g for g in got if g[1] == -9), key=str) == sorted([(None, -9, 4), (-9, -9, 4), (-9, -9, 4), (-4, -9, 4), (None, -9, 4)], key=str)
    assert sorted(g[2] for g in got if g[0] is None and g[1] != -9) == [1, 1, 1, 1, 2, 2, 2]
    assert len({g[1] for g in got if g[0] is None and g[1] != -9}) == 3
    kept = keep_one(df)
    assert kept.columns == df.columns
    left = sorted(r["_kept_s1"] for r in kept.collect())
    assert [sum(i in part for i in left) for part in ((1, 2), (5, 6, 7), (8, 9), (10, 11), (12,))] == [1] * 5 and len(left) == 5


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 4)
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = np.random.default_rng(4)
    own = [np.unique(rng.integers(0, 40, n).astype(np.uint64)) for n in (0, 3, 10, 20, 30, 30, 35, 60)]
    got = jaccard._shared(np.concatenate(own), np.repeat(np.arange(len(own)), [len(o) for o in own]), len(own))
    for a, x in enumerate(own):
        for b, y in enumerate(own):
            assert a == b or got[a, b] == len(np.intersect1d(x, y))


def test_links_in_a_loose_family(spark, monkeypatch):
    """Many texts share a passage without being linked; planted pairs among them are found."""
    monkeypatch.setattr(jaccard, "BLOCK", 200)
    rng = random.Random(5)
    core = [f"c{i}" for i in range(300)]
    docs = []
    for pair in range(400):
        own = [f"p{pair}x{i}" for i in range(90)]
        docs.append((2 * pair, " ".join(core + own)))
        changed = list(own)
        for _ in range(7):
            changed[rng.randrange(90)] = f"n{rng.random()}"
        docs.append((2 * pair + 1, " ".join(core + changed)))
    s = [sets(t) for _, t in docs]
    near = [len(s[i] & s[i + 1]) >= 0.8 * len(s[i] | s[i + 1]) for i in range(0, 800, 2)]
    loose = len(s[0] & s[2]) / len(s[0] | s[2])
    assert 0.6 < loose < 0.8 and sum(near) > 300
    rows = {r.doc_id: r for r in jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = [rows[i].class_id == rows[i + 1].class_id and rows[i].n_links == rows[i + 1].n_links == 1 for i in range(0, 800, 2)]
    alone = [rows[i].n_links == 0 for i in range(0, 800, 2)]
    assert all(a or n for a, n in zip(alone, near))
    assert sum(f and n for f, n in zip(found, near)) >= 0.99 * sum(near)


@pytest.mark.parametrize("met", [1024, 3])
def test_similar_nodes_between_unlike_ones_of_a_bucket(spark, monkeypatch, met):
    """The smallest and the largest node of the bucket are like none of the others; these are pairs."""
    monkeypatch.setattr(jaccard, "MET", met, raising=False)
    bands, rows = 4, 6
    own = np.random.default_rng(3).integers(0, 256, (12, bands * rows), dtype=np.uint8)
    kind = [0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 7, 8, 8, 9]
    nodes = [(i, np.full(bands, 7, np.int64).tobytes(), own[g].tobytes()) for i, g in enumerate(kind)]
    got = jaccard.candidate_groups(spark.createDataFrame(nodes, "node long, bands binary, sig binary"), bands, rows, 0.8).collect()
    assert sorted((r.node, r.component) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7), (8, 7), (12, 12), (13, 12)]


def test_large_buckets_equal_all_pairs():
    sig = np.random.default_rng(4).integers(0, 2, (300, 30), dtype=np.uint8)
    assert (jaccard._alike(sig, 18.2) == ((sig[:, None] == sig[None]).sum(2) >= 18.2)).all()


def test_repeated_rows_and_wrong_ids(spark):
    text = " ".join(f"r{i}" for i in range(50))
    rows = [(1, text)] * 40 + [(2, text + " more")] * 3
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, 42), (2, 1, 42)}
    with pytest.raises(TypeError):
        jaccard_classes(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_texts_under_one_id_keep_their_own_links(spark):
    t, u = (" ".join(f"{g}{i}" for i in range(60)) for g in "tu")
    rows = [(1, t), (2, t + " x"), (5, u), (3, u + " y"), (1, u)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_links, r.class_id) for r in jaccard_classes(df).collect()]
    classes = {}
    for d, n, c in got:
        classes.setdefault(c, []).append((d, n))
    assert sorted(sorted(c) for c in classes.values()) == [[(1, 1), (2, 1)], [(1, 2), (3, 2), (5, 2)]]
    assert sum(c == 1 for c in classes) == 1 and sum(c < 0 for c in classes) == 1
    assert sorted((r.doc_id, r.text) for r in keep_one(df).collect()) == [(1, t), (1, u)]


@pytest.mark.parametrize("block", [256, 4])
def test_repeated_ids_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(2)
    docs = [(rng.choice([None, d // 3, 0]), t) for d, t in cases()]
    plain = brute([(i, t) for i, (_, t) in enumerate(docs)])  # rows by number, so that ids play no part
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(docs)], "doc_id long, text string, row int")
    by_row = {}
    for i, c, _, _ in plain:
        by_row.setdefault(c, []).append(i)
    want = sorted((sorted((str(docs[i][0]), n[i]) for i in rows) for rows in by_row.values()), key=str) if (n := {i: k for i, _, k, _ in plain}) else []
    got = {}
    for r in jaccard_classes(df).collect():
        got.setdefault(r.class_id, []).append((str(r.doc_id), r.n_links))
    assert sorted((sorted(c) for c in got.values()), key=str) == want
    for c, rows in by_row.items():  # a class is called by its smallest id, or by a number of its own
        named = [k for k, v in got.items() if sorted(v) == sorted((str(docs[i][0]), n[i]) for i in rows)]
        least = min((docs[i][0] for i in rows if docs[i][0] is not None), default=None)
        assert any(k == least or k < 0 for k in named), (c, named)
    kept = [r.row for r in keep_one(df).collect()]
    assert sorted(next(c for c, rows in by_row.items() if i in rows) for i in kept) == sorted(by_row)
