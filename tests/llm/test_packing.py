import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from histarium.llm import packing
from histarium.llm.packing import END, PATTERN, TOKENIZER, Encoder, best_fit_decreasing, id_matrix, pack_documents, position_ids, read_ranks, write_packs

RANKS = read_ranks(TOKENIZER)
PLAIN = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = Encoder(RANKS)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'st 12.,é日\n\t  \x1c !"), max_size=40))
def test_stretches_encode_as_whole_texts(text):
    assert ENCODER.encode([text.encode()])[0].tolist() == PLAIN.encode_ordinary(text)


def test_many_texts_at_once_and_little_memory(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    rng, encoder = random.Random(1), Encoder(RANKS)
    for _ in range(40):
        texts = [" ".join(rng.choices([f"w{i}" for i in range(90)] + ["", "\n", "é", "tab\t", "\u3000x"], k=rng.randrange(30))) for _ in range(9)]
        assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == [PLAIN.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_best_fit_decreasing_equals_search(sizes):
    got = best_fit_decreasing(sizes, 40)
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        room = min(fits, default=40)
        if fits:
            rooms.remove(room)
        rooms.append(room - s)
    assert sorted(40 - sum(sizes[i] for i in row) for row in got) == sorted(rooms)
    assert sorted(i for row in got for i in row) == list(range(len(sizes)))


def test_round_trip(spark, tmp_path):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(["alpha", "béta", "x1", "\n", "  "], k=rng.choice([1, 9, 200, 900])))) for i in range(60)] + [(90, None), (91, ""), (92, "long " * 9000), (93, "tab\there"), (None, "no number")]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in docs], "doc_id long, text string, ids string, pack_id int")
    rows = write_packs(df, str(tmp_path / "packs"), length=256, pool_tokens=5000).collect()
    pieces = {}
    for r, ids in zip(rows, id_matrix(rows), strict=True):
        assert r.n_tokens == r.cu_seqlens[-1] <= 256 and (ids[r.n_tokens :] == END).all()
        where = position_ids(r.resets, 256)
        for doc, offset, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            pieces.setdefault(doc, []).append((offset, ids[a:b].tolist()))
            assert (where[a:b] == np.arange(b - a)).all()
    for doc, text in docs:
        tokens = [t for _, p in sorted(pieces[doc]) for t in p]
        assert tokens == [*PLAIN.encode_ordinary(text or ""), END]


def test_empty_table_and_full_rows(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert position_ids([0], 4).tolist() == [0, 1, 2, 3]
    assert packing.Capacities(8).take(3) is None


def test_repeated_rows_and_ids_are_packed_each(spark):
    rows = [(7, "one two"), (7, "one two"), (None, "one two"), (None, None), (7, "other")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(str(d) for r in got for d in r.doc_ids) == ["7", "7", "7", "None", "None"]
    assert sum(r.n_tokens for r in got) == sum(len(PLAIN.encode_ordinary(t or "")) + 1 for _, t in rows)


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError):
        pack_documents(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
