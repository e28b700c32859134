"""Where intermediate tables go, and that they go away."""

import os
from types import SimpleNamespace

import pytest

from histarium.functions.lineage import discard, saved, shared_dir


def test_saved_tables_can_be_discarded(spark):
    table = saved(spark.range(10))
    path = table._saved_at.removeprefix("file:")
    assert os.path.isdir(path) and table.count() == 10
    discard(table, None, spark.range(3))
    assert not os.path.exists(path)


def test_a_cluster_must_name_the_shared_folder():
    folder = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="yarn", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: folder)))
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session)
