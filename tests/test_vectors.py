"""Queries over embeddings use every component and the operators' own settings."""

import os

import pytest

from histarium import queries
from histarium.operators import batches, clustering

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


class Called(Exception):
    pass


@pytest.mark.parametrize("name, module, operator", [("b3_combat", batches, "combat"), ("u1_pca", clustering, "pca"), ("u2_kmeans", clustering, "kmeans"), ("u7_k_search", clustering, "k_search")])
def test_all_components(spark, monkeypatch, name, module, operator):
    def call(df, *args, **settings):
        raise Called(df.columns, args, settings)

    monkeypatch.setattr(module, operator, call)
    with pytest.raises(Called) as said:
        queries.queries()[name](spark, SF)
    columns, args, settings = said.value.args
    want = [f"e{i}" for i in range(64)]
    assert set(want) <= set(columns) and want in args and "n_init" not in settings
