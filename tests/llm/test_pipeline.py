"""The corpus pipeline against its stages done plainly, on a small table of its own."""

import random

import corpus_pipeline
from plain import fair_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    vocabulary = [f"wort{i}" for i in range(900)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    item = text(30)
    docs = [(i, text(rng.randrange(40, 90))) for i in range(240)]
    docs += [(300 + i, docs[i][1]) for i in range(6)]  # copies
    docs += [(310 + i, docs[10 + i][1].replace(docs[10 + i][1].split()[3], "neu", 1)) for i in range(5)]  # near copies
    docs += [(330 + i, " ".join(w + "###" for w in text(30).split())) for i in range(4)] + [(340, "kurz"), (341, None)]
    docs += [(350, f"{text(40)} {item} {text(40)}"), (351, item)]
    return [(d, t, "de", f"s{d % 3}", len(t or "")) for d, t in docs], item


def test_pipeline_equals_plain_stages(spark, tmp_path):
    docs, item = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    gone = {*range(300, 306), *range(310, 315), *range(330, 334), 340, 341, 351}
    kept = {d: (t.replace(item, ""), s) for d, t, _, s, _ in docs if d not in gone}
    assert {r.doc_id for r in rows} <= set(kept)
    for r in rows:
        assert r.size == len(kept[r.doc_id][0].encode()) + 1
    sizes = {}
    for t, s in kept.values():
        sizes[s] = sizes.get(s, 0) + len(t.split())
    targets = fair_targets(sizes)
    for s, target in targets.items():
        taken = sum(len(kept[r.doc_id][0].split()) for r in rows if kept[r.doc_id][1] == s)
        assert abs(taken - target) < 200
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in order] == sorted(r.doc_id for r in rows)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs, item = corpus()
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.createDataFrame(docs, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(r.n_chars == len(r.text) for r in now.collect())


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
