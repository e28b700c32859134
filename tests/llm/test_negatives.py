import numpy as np
import pytest
from pyspark.sql import functions as F

from histarium.llm import negatives
from histarium.llm.negatives import bit_planes, mine_negatives, subset_tables, table_scores

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor, scale=256, positives=5, negatives=3, lowest=50, highest=95):
    held = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        held.append((i, [int(np.floor(float(np.float32(x)) * scale)) for x in v], label))
    out = []
    for n, (i, v, label) in enumerate(held):
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, m) for m, (j, w, _) in enumerate(held) if m != n)
        for s, p, _ in [x for x in scored if held[x[2]][2] == label][:positives]:
            rest = [x for x in scored if held[x[2]][2] != label and -lowest * s <= -100 * x[0] <= -highest * s]
            out += [(i, p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(rest[:negatives])]
    return sorted(out)


def rows(n=240, dims=19, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dims))
    out = [(int(i), [float(x) for x in centre[i % 4] * 0.4 + rng.normal(size=dims) * 0.5], int(i % 3)) for i in range(n)]
    same = [0.25] * dims
    out += [(1000 + i, same, i % 2) for i in range(40)]  # ties
    out += [(2000, None, 1), (2001, [1.0] * dims, None), (2002, [float("nan")] + [0.1] * (dims - 1), 1), (2003, [0.1] * (dims - 1) + [None], 1), (2004, [float("inf")] * dims, 0)]
    out += [(None, same, 1), (50, same, 2), (50, same, 2), (2005, [], 1), (2010, [0.9, -0.9], 2), (-10, [-7.5] * dims, 1)]
    rng.shuffle(out)
    return [tuple(r) for r in out]


@pytest.mark.parametrize("dims, bits", [(1, 2), (8, 5), (19, 12), (64, 10)])
def test_scores_from_tables_are_inner_products(dims, bits):
    rng = np.random.default_rng(dims)
    a, b = rng.integers(-(1 << (bits - 1)), 1 << (bits - 1), (37, dims)), rng.integers(-(1 << (bits - 1)), 1 << (bits - 1), (53, dims))
    tables, planes = subset_tables(a), bit_planes(b, bits)
    assert tables.shape == (-(-dims // 8), 256, 37) and planes.shape == (53, bits, -(-dims // 8))
    assert (table_scores(planes, tables) == b @ a.T).all()


@pytest.mark.parametrize("block, anchors, size", [(4096, 128, 2048), (7, 3, 10)])
def test_equals_brute_force(spark, monkeypatch, block, anchors, size):
    for name, value in (("ANCHORS_OF_A_PASS", block), ("ANCHORS", anchors), ("ROWS", size)):
        monkeypatch.setattr(negatives, name, value)
    given = rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in given], SCHEMA + ", row int, planes string").repartition(3)
    got = sorted(map(tuple, mine_negatives(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == brute(given, lambda i: i % 10 == 0) and len(got) > 100


def test_results_of_many_passes_are_gathered(spark, monkeypatch):
    parts = []
    for i in range(40):
        negatives._gather(parts, spark.createDataFrame([(i,)], "i int"), most=3)
    held = [t for level in parts for t in level]
    assert len(held) < 8 and sorted(r.i for t in held for r in t.collect()) == list(range(40))


def test_labels_as_text_few_rows_and_empty_table(spark):
    same = mine_negatives(spark.createDataFrame([(0, [1.0], "a"), (1, [1.0], "a"), (2, [0.7], "b"), (3, [0.99], "b")], "vec_id long, embedding array<double>, label string"), F.col("vec_id") == 0)
    assert list(map(tuple, same.collect())) == [(0, 1, 1, 2, 256 * 256, 256 * 179)]
    assert mine_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    assert mine_negatives(spark.createDataFrame([(0, [1.0], 1)], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    with pytest.raises(ValueError):
        mine_negatives(spark.createDataFrame([(0, [1e30], 1)], SCHEMA), F.lit(True))
