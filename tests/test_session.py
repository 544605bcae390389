"""Session helpers: the shared folder outside local mode, shipping the package."""

import types

import pytest

from zonepulse import session


def _fake(master, configured=None, current=None):
    conf = types.SimpleNamespace(get=lambda key, default=None: configured)
    set_to = []
    sc = types.SimpleNamespace(
        getConf=lambda: conf, getCheckpointDir=lambda: current, master=master, setCheckpointDir=set_to.append)
    return types.SimpleNamespace(sparkContext=sc, conf=conf), set_to


def test_a_cluster_needs_a_shared_folder():
    spark, _ = _fake("spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(spark)


def test_the_configured_folder_is_used():
    spark, set_to = _fake("spark://host:7077", configured="hdfs://shared/ckpt")
    assert session.shared_path(spark, "a", "b") == "hdfs://shared/ckpt/a/b"
    assert set_to == ["hdfs://shared/ckpt"]


def test_the_package_is_shipped_once(spark):
    session.ship_package(spark)
    before = len(spark.sparkContext._python_includes)
    session.ship_package(spark)
    assert len(spark.sparkContext._python_includes) == before >= 1
