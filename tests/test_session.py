from types import SimpleNamespace

import pytest

from patchloom import session
from patchloom.sinks import files


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    conf = SimpleNamespace(get=lambda *_: None)
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, _patchloom_shipped=True)
    with pytest.raises(RuntimeError, match="shared folder"):
        session.shared_root(SimpleNamespace(sparkContext=sc, conf=conf))


def test_every_row_meets_every_block_once(spark):
    rows = spark.range(50).withColumnRenamed("id", "a")
    small = spark.range(23).withColumnRenamed("id", "b")
    for block, n in ((100, 1), (5, 5)):
        met, n_blocks = session.beside(rows, small, "t", block)
        assert n_blocks == n
        assert sorted((r["a"], e["b"]) for r in met.collect() for e in r["t"]) == [(a, b) for a in range(50) for b in range(23)]
    assert session.beside(rows, small.limit(0), "t")[0].collect()[0]["t"] == []


def test_every_split_is_in_the_data_file(spark, tmp_path):
    routed = spark.range(130).selectExpr("concat('s', id) AS split", "concat('/p/', id) AS path")
    files.training_folder(routed, str(tmp_path / "t"))
    assert sum(": lists/split=" in x for x in (tmp_path / "t/data.yaml").read_text().splitlines()) == 130
