import os
from types import SimpleNamespace

import pytest

from panelweave import pin, release, scope
from panelweave.sources.workspace import shared_folder


def session(**settings):
    settings = {f"spark.{k.replace('_', '.')}": v for k, v in settings.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: settings.get(k, d)))


def test_the_cluster_names_the_folder():
    cluster = session(checkpoint_dir="hdfs://shared/x/", master="yarn", app_id="a1")
    assert shared_folder(cluster) == "hdfs://shared/x/panelweave-a1"


def test_a_cluster_without_a_folder_is_refused():
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(session(master="spark://host:7077", app_id="a2"))


def test_a_local_session_gets_a_folder_of_its_own():
    local = session(master="local[2]", app_id="a3")
    assert shared_folder(local) == shared_folder(local)
    assert os.path.isdir(os.path.dirname(shared_folder(local)))


def test_pinned_tables_are_read_back_and_released(spark):
    table = pin(spark.range(5))
    assert table.count() == 5
    folder = shared_folder(spark)
    assert os.listdir(folder)
    release(spark)
    assert not os.path.exists(folder)


def test_a_scope_deletes_only_its_own_tables(spark):
    kept = pin(spark.range(5))
    with scope(spark):
        inner = pin(spark.range(7))
        assert inner.count() == 7
        path = inner.inputFiles()[0].removeprefix("file:").replace("//", "/")
        assert os.path.exists(path)
    assert not os.path.exists(path)
    assert kept.count() == 5
    release(spark)
