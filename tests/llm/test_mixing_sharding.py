import random
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pytest

from histarium.llm import mixing
from histarium.llm.mixing import mix_documents, mix_table
from histarium.llm.sharding import assign_shards, write_shards
from plain import fair_targets

SCHEMA = "doc_id long, text string, source string, size int, target string"


def cases():
    rng = random.Random(6)
    docs = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "a", "a", "b", "ç", None]), 7, "x") for i in range(300)]
    return docs + [(900, None, "a", 0, None), (901, "", "zero", 0, None), (None, "x y", "b", 0, None), (5, docs[5][1], docs[5][2], 7, "x"), (902, "long " * 4000, "b", 0, None)]


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, None: 0}, {"a": 10, "b": 0}, {}, {f"h{i:03}": (i * 37) % 101 for i in range(200)} | {None: 9}])
def test_targets_fill_and_share(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(3)
    targets, budget = mixing.fair_targets(df)
    got = {r.source: r.target for r in targets.collect()}
    assert got == pytest.approx(fair_targets(sizes)) and budget == int(1.5 * sum(sizes.values()))


def test_mix_equals_fair_queueing(spark):
    docs = cases()
    df = spark.createDataFrame(docs, SCHEMA)
    rows = mix_table(df).collect()
    sizes = Counter()
    for _, t, s, _, _ in docs:
        sizes[s] += len((t or "").split())
    targets, queues = fair_targets(dict(sizes)), defaultdict(list)
    for d, t, s, _, _ in docs:
        key = md5(f"{'null' if d is None else d}:mix".encode()).hexdigest()
        queues[s].append((key, md5((t or "").encode()).hexdigest(), d, len((t or "").split())))
    sent = []
    for s, q in queues.items():
        q.sort(key=lambda x: x[:2])
        at = 0
        for epoch in range(2):
            for place, x in enumerate(q):
                at += x[3]
                if x[3]:
                    sent.append((at / targets[s], s is None, s or "", place, epoch, x[2], x[3]))
    sent.sort(key=lambda x: x[:5])
    taken, upto = Counter(), 0
    for x in sent:
        upto += x[6]
        if upto > int(1.5 * sum(sizes.values())):
            break
        taken[x[5]] += x[6]
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.taken
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
    assert len(rows) == len(docs) and {k: v for k, v in got.items() if v} == dict(taken)
    again = mix_table(df.repartition(11)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    mixed = mix_documents(df)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert dict(words) == dict(taken)


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mix_table(none).count() == mix_documents(none).count() == 0
    empty = spark.createDataFrame([(1, None, "a", 0, ""), (2, "", None, 0, "")], SCHEMA)
    assert [r.taken for r in mix_table(empty).collect()] == [0, 0] and mix_documents(empty).count() == 0


def test_shards_are_contiguous_and_even(spark):
    docs = cases()
    rows = assign_shards(spark.createDataFrame(docs, SCHEMA), 7).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    ids = [float("inf") if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)
    for k in {r.shard for r in rows}:
        assert [r.slot for r in order if r.shard == k] == list(range(sum(r.shard == k for r in rows)))
    total, before = sum(r.size for r in rows), 0
    for r in order:
        assert r.shard == min(6, (2 * before + r.size) * 7 // (2 * total))
        before += r.size


def test_shards_split_equal_rows_and_take_empty_tables(spark):
    rows = assign_shards(spark.createDataFrame([(1, "same", "a", 1, "t")] * 64, SCHEMA), 4).collect()
    assert Counter(r.shard for r in rows) == {0: 16, 1: 16, 2: 16, 3: 16}
    assert assign_shards(spark.createDataFrame([], SCHEMA), 4).count() == 0


def test_written_shards_hold_all_documents(spark, tmp_path):
    df = spark.createDataFrame([(i, "t" * (i % 9), "a", i, "x") for i in range(50)], SCHEMA)
    placed = write_shards(df, f"{tmp_path}/shards", 4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted((r.doc_id, r.shard) for r in back.collect()) == sorted((r.doc_id, r.shard) for r in placed.collect())
