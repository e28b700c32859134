import random
import re
from hashlib import sha256

import pytest

from histarium.llm import decontaminate as module
from histarium.llm.decontaminate import contamination_table, decontaminate, item_pieces

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = {}
    windows = []
    for item, text in items:
        w = normal(text)
        windows += [(tuple(w[i : i + 10]), item) for i in range(max(1, len(w) - 9))] if w else []
    for doc, text in docs:
        w, hit, met = normal(text), set(), set()
        for win, item in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    met.add(str(item))
        out[doc] = (len(w), len(hit), len(met), sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit))
    return out


def cases():
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "Über", "d9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 6, 9, 10, 14, 25])))) for i in range(12)] + [(50, None), (51, ""), (52, "rare"), (53, "rare")]
    docs = []
    for d in range(60):
        w = rng.choices(vocabulary + ["zz"] * rng.randrange(3), k=rng.randrange(60))
        if d % 3 == 0:
            w += normal(rng.choice(items[:12])[1])
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w).title()))
    return docs + [(100, None), (101, ""), (102, "x " * 40000 + "RARE."), (103, "A" * 5000)], items


@pytest.mark.parametrize("words, parts", [(1_000_000, 1), (12, 7)])
def test_table_equals_brute_force(spark, words, parts):
    docs, items = cases()
    items = [x for x in items if x[1] is None or len(normal(x[1])) != 1 or x[1] == "rare"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert item_pieces(bench, part_words=words)[1] >= parts
    got = contamination_table(spark.createDataFrame([(*d, 0, 1) for d in docs], "doc_id long, text string, _k1 int, n_hit int"), bench, part_words=words)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()} == brute(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    none = spark.createDataFrame([], "doc_id long, text string")
    assert contamination_table(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    got = contamination_table(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert got.filter("contaminated").count() == 0


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(module, "PIECE_WORDS", 30)
    rng = random.Random(7)
    items = [(i, " ".join(rng.choices("abcdefgh", k=k))) for i, k in enumerate((31, 39, 40, 41, 200))]
    docs = [(i, items[4][1][2 * i : 2 * i + 40] + " zz " + rng.choice(items)[1][-30:]) for i in range(60)] + [(90, items[4][1])]
    got = contamination_table(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()} == brute(docs, items)


def test_null_and_text_ids(spark):
    rows = [(None, "one two three"), ("x", None), ("x", "one two three")]
    got = contamination_table(spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame([(None, "two")], "item_id long, text string"))
    assert sorted(((r.doc_id, r.n_hit, r.n_items) for r in got.collect()), key=str) == [("x", 0, 0), ("x", 1, 1), (None, 1, 1)]


@pytest.mark.parametrize("words", [1_000_000, 6])
def test_cut_spans_and_leave_the_rest(spark, words):
    item = " ".join(f"w{i}" for i in range(12))
    long = " ".join(f"v{i}" for i in range(30))
    rows = [(1, f"{long}. {item.upper()}, {long}", 0, "x"), (2, item, 0, "y"), (3, long, 7, None), (4, None, 7, "z"), (4, None, 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, item_id string")
    got = decontaminate(docs, spark.createDataFrame([(9, item)], "item_id long, text string"), length_col="n_chars", part_words=words)
    assert got.columns == docs.columns
    cut = f"{long}. , {long}"
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, cut, len(cut), "x"), *rows[2:]], key=str)
