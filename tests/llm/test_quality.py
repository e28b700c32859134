import random
import re
from collections import Counter

import pytest

from histarium.llm import quality
from histarium.llm.quality import fences, judged, keep_good, quality_table, sketches, with_counts

SCHEMA = "doc_id long, text string, lang string, source string, _words int, _limits string, _h string, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def cases():
    rng = random.Random(9)
    words = [f"wort{i}" for i in range(500)] + ["é", "日本語", "a\x0bb"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, text(rng.randrange(20, 90)), rng.choice(["de", "en", None]), rng.choice(["s0", "s1", None])) for i in range(300)]
    docs += [(400 + i, " ".join(w + "***" for w in text(40).split()), "de", "s0") for i in range(10)]
    docs += [(500, None, "en", None), (501, "", None, "s1"), (502, "x y z " * 3000, "de", "s1"), (503, "same line here\n" * 30, "en", "s0"), (504, " \t\n ", "en", "s0"), (5, docs[5][1], docs[5][2], docs[5][3])]
    return [(*d, 1, "l", "h", "n") for d in docs]


def test_counts_equal_brute_force_and_junk_goes(spark):
    docs = cases()
    df = spark.createDataFrame(docs, SCHEMA)
    rows = quality_table(df).collect()
    want = Counter((d, *counts(t)) for d, t, *_ in docs)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (r.doc_id < 300) and (r.reason is None) == r.kept
    kept = keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d[0] for d in docs if d[0] < 300)


def test_sketches_merge_in_any_order(spark):
    df = with_counts(spark.createDataFrame(cases(), SCHEMA))
    whole = Counter({tuple(r)[:4]: r.n for r in sketches(df, "lang", "source").collect()})
    parts = Counter()
    for k in range(3):
        parts.update({tuple(r)[:4]: r.n for r in sketches(df.filter(f"pmod(hash(text), 3) = {k}"), "lang", "source").collect()})
    assert whole == parts


def test_small_groups_take_merged_thresholds(spark):
    df = with_counts(spark.createDataFrame(cases(), SCHEMA))
    limits = {(r.lang, r.source): r.limits for r in fences(sketches(df, "lang", "source"), min_group=10_000).collect()}
    assert len({str(sorted(v.items())) for v in limits.values()}) == 1
    assert set(next(iter(limits.values()))) == set(quality.LEAST_SPREAD)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality_table(none).count() == 0 and keep_good(none).count() == 0


@pytest.mark.parametrize("most", [0, 100_000])
def test_extra_columns_and_both_joins(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", most)
    df = spark.createDataFrame(cases(), SCHEMA)
    out = judged(df)
    assert out.columns == [*df.columns, "_q", "_v"]
    assert {r._h for r in out.collect()} == {"h"} and {r._limits for r in out.collect()} == {"l"}
    assert sorted(r.doc_id for r in out.filter("_v.kept").collect()) == sorted(r.doc_id for r in keep_good(df).collect())


def test_taken_names_are_an_error(spark):
    with pytest.raises(ValueError):
        with_counts(spark.createDataFrame([("x", 1)], "text string, _Q int"))
