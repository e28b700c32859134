"""Spanning forests and density clusters against plain versions."""

import numpy as np
import pytest

from histarium.operators import clustering, dendrogram
from histarium.operators.components import spanning_forest


def kruskal(edges):
    root, out = {}, set()

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if a != b):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.add((a, b, w))
    return out


def test_forest_equals_kruskal(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 220), rng.integers(0, 60, 220), rng.integers(0, 9, 220), strict=True)]
    edges += [(100, 101, 1.0), (101, 102, 2.0), (102, 100, 3.0), (200, 200, 0.0)]
    got = spanning_forest(spark.createDataFrame(edges, "src long, dst long, w double"))
    assert {tuple(r) for r in got.collect()} == kruskal(edges)
    assert spanning_forest(spark.createDataFrame([], "src long, dst long, w double")).count() == 0


def plain_clusters(forest, least, selection="eom"):
    """{chosen cluster: its points} of a forest, by cutting its heaviest edges one after the other."""

    def parts(points, edges):
        if not edges:
            return [({p}, []) for p in points]
        first = edges[0]
        rest = edges[1:]
        near = {}
        for w, a, b in rest:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        out = []
        for end in first[1:]:
            seen, todo = {end}, [end]
            while todo:
                for q in near.get(todo.pop(), ()):
                    if q not in seen:
                        seen.add(q)
                        todo.append(q)
            out.append((seen, [e for e in rest if e[1] in seen]))
        return out

    def grow(points, edges, birth):
        """(stability, best, chosen) of a cluster and what is in it."""
        whole, mass = set(points), 0.0
        while True:
            w = max(edges[0][0], 1e-12)
            big = [p for p in parts(points, edges) if len(p[0]) >= least]
            if len(big) == 1:
                mass += (len(points) - len(big[0][0])) * (1 / w - birth)
                points, edges = big[0]
                continue
            mass += len(points) * (1 / w - birth)
            below = [grow(p, e, 1 / w) for p, e in big]
            total = sum(b for _, b, _ in below)
            if not below or (selection == "eom" and mass >= total):
                return mass, mass, [whole]
            return mass, max(mass, total), [c for _, _, cs in below for c in cs]

    heavy = sorted(((w, a, b) for a, b, w in forest), key=lambda e: (e[0], min(e[1:]), max(e[1:])), reverse=True)
    trees, left = [], {p for e in heavy for p in e[1:]}
    while left:
        seen, todo = set(), [next(iter(left))]
        while todo:
            p = todo.pop()
            if p not in seen:
                seen.add(p)
                todo += [q for _, a, b in heavy for q in (a, b) if p in (a, b)]
        trees.append((seen, [e for e in heavy if e[1] in seen]))
        left -= seen
    return {frozenset(c) for points, edges in trees if len(points) >= least for c in grow(points, edges, 1 / max(edges[0][0], 1e-12))[2]}


def groups(rows, node, label):
    out = {}
    for r in rows:
        if r[label]:
            out.setdefault(r[label], set()).add(r[node])
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("selection, least", [("eom", 2), ("eom", 4), ("leaf", 3)])
def test_clusters_of_a_forest_equal_a_plain_tree(spark, selection, least):
    forest = []
    for seed, ties in ((1, False), (2, False), (3, True)):
        rng = np.random.default_rng(seed)
        nodes = [1000 * seed + int(n) for n in rng.permutation(90)]
        for i, n in enumerate(nodes):
            if i % 45:  # two trees; some nodes hang in long rows
                other = nodes[i - 1] if rng.random() < 0.3 else nodes[i - i % 45 + int(rng.integers(0, i % 45))]
                forest.append((n, other, float(rng.integers(1, 6) if ties else rng.random() + 0.01)))
    forest.append((200, 201, 1.0))
    got = dendrogram.forest_clusters(spark.createDataFrame(forest, "src long, dst long, w double"), least, selection).collect()
    assert groups([r.asDict() | {"cluster": r.cluster + 1} for r in got], "node", "cluster") == plain_clusters(forest, least, selection)


def test_a_tree_of_great_depth(spark):
    """Edges that get heavier one after the other: each is the parent of the one before."""
    n = 600
    forest = [(i, i + 1, 1.0 + i * 0.01 + (0.5 if i % 7 == 3 else 0)) for i in range(n)] + [(i, 1000 + i, 1.005 + i * 0.01) for i in range(n)]
    df = spark.createDataFrame([(a, b, float(w)) for a, b, w in forest], "src long, dst long, w double").repartition(3)
    got = dendrogram.forest_clusters(df, 3).collect()
    assert groups([r.asDict() | {"cluster": r.cluster + 1} for r in got], "node", "cluster") == plain_clusters(forest, 3)


def test_two_blobs_and_a_far_point(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 0.3, (7, 2)), rng.normal(4, 0.3, (7, 2)), [[20.0, 20.0]]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(99, float("nan"), 1.0)], "k long, a double, b double")
    got = {r.k: r.cluster for r in clustering.density_clusters(df, "k", ["a", "b"], min_cluster_size=4, min_samples=2).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order, core = np.argsort(d, axis=1, kind="stable"), np.sort(d, axis=1)[:, 1]
    forest = kruskal([(i, int(j), max(d[i, j], core[i], core[j])) for i in range(len(x)) for j in order[i, :4]])
    assert groups([{"k": k, "c": c} for k, c in got.items()], "k", "c") == plain_clusters(forest, 4)
    assert got[99] == 0 and sorted(set(got.values()) - {0}) == [1, 2] and len({got[i] for i in range(7)}) == 1


def test_empty_and_small_forests(spark):
    for rows in ([], [(1, 2, 1.0)]):
        assert dendrogram.forest_clusters(spark.createDataFrame(rows, "src long, dst long, w double"), 5).count() == 0
