"""Prefix sums, ranks and quantiles against plain versions, with one group over most rows."""

import random
from collections import Counter

import numpy as np

from histarium.functions.prefix import average_rank, quantiles, running_sums


def rows():
    rng = random.Random(3)
    out = [("hot", rng.choice([1.0, 2.0, 2.5, rng.random()]), rng.randrange(5)) for _ in range(500)]
    out += [(rng.choice(["a", "b", None]), rng.random(), rng.randrange(5)) for _ in range(80)]
    return out + [("one", 7.0, 3)]


def test_running_sums_per_group_and_in_all(spark):
    data = rows()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i long, g string, v double, n int").repartition(7)
    for group in (None, "g"):
        order = sorted(range(len(data)), key=lambda i: (data[i][0] is not None, data[i][0] or "", data[i][1], i))
        before, seen, want = Counter(), Counter(), {}
        for i in order:
            key = data[i][0] if group else 0
            want[i] = before[key], seen[key]
            before[key] += data[i][2]
            seen[key] += 1
        got = {r.i: (r._before, r._index) for r in running_sums(df, ["g", "v", "i"], "n", group).collect()}
        assert got == want


def test_several_sums_and_empty_table(spark):
    df = spark.createDataFrame([(i, i, 2 * i) for i in range(20)], "i long, a long, b int")
    got = running_sums(df, ["i"], ["a", "b"]).collect()
    assert {(r.i, r._before_a, r._before_b) for r in got} == {(i, i * (i - 1) // 2, i * (i - 1)) for i in range(20)}
    assert running_sums(df.limit(0), ["i"], "a").count() == 0


def test_ranks_and_quantiles(spark):
    data = [r for r in rows() if r[0]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i long, g string, v double, n int")
    ranks = {r.i: r["rank"] for r in average_rank(df, ["g"], "v").collect()}
    for i, (g, v, _) in enumerate(data):
        same = [x for h, x, _ in data if h == g]
        assert ranks[i] == sum(x < v for x in same) + (sum(x == v for x in same) + 1) / 2
    shares = [0.0, 0.1, 0.5, 0.99, 1.0]
    for by in (["g"], []):
        for r in quantiles(df, by, "v", shares).collect():
            own = [x for h, x, _ in data if not by or h == r.g]
            assert np.allclose(r.q, np.quantile(own, shares))
    assert quantiles(df.limit(0), ["g"], "v", shares).count() == 0
