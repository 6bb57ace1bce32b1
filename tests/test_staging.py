"""Intermediate tables go where all machines see them."""

from types import SimpleNamespace

import pytest

from loomlog.plans import staging


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(applicationId="app", master=master, getConf=lambda: conf))


def test_shared_folder():
    assert staging.shared_root(fake("spark://x:7077", "hdfs://a/b/")) == "hdfs://a/b/loomlog/app"
    assert staging.shared_root(fake("local[4]")).startswith("file:///")
    for master in ("spark://x:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError):
            staging.shared_root(fake(master))


def test_scratch_tables_go(spark):
    with staging.Scratch(spark) as scratch:
        a, b = scratch.stage(spark.range(5), "gone"), scratch.stage(spark.range(7).repartition(4), "kept", parts=1, keep=True)
        assert a.count() == 5
    assert b.count() == 7 and len(b.inputFiles()) == 1
    with pytest.raises(Exception, match="(?i)not exist|FAILED_READ_FILE"):
        a.collect()
