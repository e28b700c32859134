import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from histarium.llm import merkle
from histarium.llm.merkle import fold, manifest_table, merkle_nodes, merkle_proofs, verify_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r):
    doc_id, text, lang, source, n_chars = r
    return H(*map(field, (doc_id, source, lang, n_chars, text)))


def levels(leaves, fanout):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, i, fanout):
    """(left, right) of the way up, level by level."""
    out = []
    for level in tree[:-1]:
        first = i - i % fanout
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
        i //= fanout
    return out


def brute(rows, fanout=2):
    """(row, leaf, subroot, root, steps) by plain lists."""
    trees = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    own = {k: levels([leaf(r) for r in trees[k]], fanout) for k in names}
    top = levels([own[k][-1][0] for k in names], fanout)
    return [(r, own[k][0][i], own[k][-1][0], top[-1][0], siblings(own[k], i, fanout) + siblings(top, j, fanout)) for j, k in enumerate(names) for i, r in enumerate(trees[k])]


def rows(sizes=(37, 1, 2, 16, 5), seed=3):
    rng = random.Random(seed)
    langs = [None, "en", "é", "日本", "", "de"]
    out, i = [], 0
    for lang, n in zip(langs, sizes, strict=False):
        for _ in range(n):
            out.append((i, rng.choice([None, "", "a b", "日本語 text", "x" * rng.randrange(50)]), lang, rng.choice([None, "s1", ""]), rng.choice([None, 0, -3, 17])))
            i += rng.randrange(1, 4)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("fanout, block", [(2, 4096), (2, 4), (3, 9), (2, 2)])
def test_proofs_equal_brute_force(spark, monkeypatch, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    given = rows() + [(4, "twice", "en", "s", 5)] * 2 + [(None, "no id", "de", None, None), (4, "third", "en", "s", 5)]
    got = merkle_proofs(spark.createDataFrame(given, SCHEMA), fanout=fanout).collect()
    told = sorted((r.doc_id is not None, r.doc_id or 0, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.steps)) for r in got)
    assert told == sorted((r[0] is not None, r[0] or 0, own, sub, root, tuple(steps)) for r, own, sub, root, steps in brute(given, fanout))


def test_contract_columns(spark):
    given = rows()
    got = {r.doc_id: r for r in manifest_table(spark.createDataFrame([(*r, "x", 1) for r in given], SCHEMA + ", tree string, lo int")).collect()}
    assert len(got) == len(given)
    hits = 0
    for r, own, sub, root, steps in brute(given):
        t = got[r[0]]
        assert (t.leaf, t.subroot, t.root, t.proof_sha256) == (own, sub, root, H(*[a + b for a, b in steps]))
        hit = zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
        now = leaf((*r[:4], r[4] + 1)) if hit else own
        for a, b in steps:
            now = H(a, now, b)
        assert t.folded_root == now and t.verified == (not hit)
        hits += hit
    assert hits


@pytest.mark.parametrize("block", [4096, 4])
def test_nodes_cover_their_leaves(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    given = rows()
    nodes = merkle_nodes(spark.createDataFrame(given, SCHEMA)).collect()
    trees = {}
    for n in nodes:
        trees.setdefault(n.tree, []).append(n)
    assert set(trees) == {"", "-", "=en", "=é", "=日本", "="}
    for held in trees.values():
        size = max(n.hi for n in held)
        assert sum(n.level == 0 for n in held) == size and sum(n.lo == 0 and n.hi == size for n in held) == 1
        for n in held:
            below = sorted((c for c in held if c.level == n.level - 1 and n.lo <= c.lo and c.hi <= n.hi), key=lambda c: c.lo)
            if n.level:
                assert n.digest == H(*[c.digest for c in below]) and [c.lo for c in below] + [n.hi] == [n.lo, *[c.hi for c in below]]


def test_a_changed_row_shows_in_its_proof_and_on_its_way_up(spark):
    given = rows((40, 9))
    df = spark.createDataFrame(given, SCHEMA)
    changed = df.withColumn("text", F.when(F.col("doc_id") == given[0][0], "other").otherwise(F.col("text")))
    proofs = merkle_proofs(df)
    told = {r.doc_id: r.verified for r in verify_manifest(proofs, changed.unionByName(spark.createDataFrame([(-5, "new", "en", "s", 1)], SCHEMA))).collect()}
    assert {k for k, v in told.items() if not v} == {given[0][0], -5}
    key = ["tree", "level", "lo", "hi", "digest"]
    apart = merkle_nodes(changed).select(key).join(merkle_nodes(df).select(key), key, "left_anti").collect()
    tree = "-" if given[0][2] is None else "=" + given[0][2]
    assert {n.tree for n in apart} == {tree, ""} and len({n.lo for n in apart if n.tree == tree and n.level == 0}) == 1
    leaf_at = next(n.lo for n in apart if n.tree == tree and n.level == 0)
    assert all(n.lo <= leaf_at < n.hi for n in apart if n.tree == tree)
    assert proofs.withColumn("up", fold(F.col("leaf"), F.col("steps"))).filter("up != root").count() == 0


def test_one_row_empty_table_and_errors(spark):
    one = [(1, None, None, None, None)]
    got = manifest_table(spark.createDataFrame(one, SCHEMA)).collect()
    assert len(got) == 1 and got[0].leaf == got[0].subroot == got[0].root == got[0].folded_root and got[0].proof_sha256 == H("") and got[0].verified
    empty = spark.createDataFrame([], SCHEMA)
    assert manifest_table(empty).count() == 0 and merkle_nodes(empty).count() == 0
    with pytest.raises(ValueError):
        merkle_nodes(empty, fanout=1)
