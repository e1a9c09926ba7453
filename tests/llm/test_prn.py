import hashlib

import pytest
from pyspark.sql import functions as F

from patchloom.llm import prn

CONFIGS = "config_id BIGINT, seed BIGINT, sample_share DOUBLE, relative STRING"


def number(text):
    return int(hashlib.sha256(text.encode()).hexdigest()[:13], 16) / 2**52


def records(spark, first, last, batch=0, parts=3):
    return spark.range(first, last).selectExpr("concat('d/', id, '.jpg') relative", f"{batch} batch_no", "'x' id").repartition(parts)


def sample(spark, store, configs):
    return {(r["config_id"], r["id"]) for r in prn.select(store.read(), store.thresholds(configs, "config_id")).collect()}


@pytest.fixture
def configs(spark):
    return spark.createDataFrame([(1, 7, 0.2, "x"), (2, 7, 0.1, "x"), (3, None, 0.5, "x"), (4, 0, 0.5, "x"), (5, -3, 1.0, "x"), (6, 1 << 40, None, "x"), (7, 9, 0.0, "x")], CONFIGS)


def test_members_are_those_of_the_definition(spark, tmp_path, configs):
    store = prn.PermanentNumbers(spark, str(tmp_path / "s"))
    store.insert(records(spark, 0, 400), "relative", "batch_no")
    inside = lambda seed, share, i: (number(f"id:d/{i}.jpg") - number(f"start:{seed}")) % 1 < share
    want = {(c, f"d/{i}.jpg") for c, seed, share in ((1, 7, 0.2), (2, 7, 0.2), (3, 0, 0.5), (4, 0, 0.5), (5, -3, 1.0)) for i in range(400) if inside(seed, share, i)}
    assert sample(spark, store, configs) == want
    assert len([1 for c, _ in want if c == 5]) == 400 and 40 < len([1 for c, _ in want if c == 1]) < 120


def test_growth_keeps_members_whatever_the_arrivals(spark, tmp_path, configs):
    one = prn.PermanentNumbers(spark, str(tmp_path / "one"))
    one.insert(records(spark, 0, 300), "relative", "batch_no")
    steps = prn.PermanentNumbers(spark, str(tmp_path / "steps"))
    before = set()
    for batch, (first, last) in enumerate([(200, 300), (0, 120), (100, 250), (0, 0), (0, 300)]):
        steps.insert(records(spark, first, last, batch, parts=batch + 1), "relative", "batch_no")
        now = sample(spark, steps, configs)
        assert before <= now
        before = now
    assert before == sample(spark, one, configs)
    assert steps.read().count() == 300 and steps.read().where("id = 'd/110.jpg'").collect()[0]["first_seen"] == 1


def test_nulls_repeats_and_empty(spark, tmp_path, configs):
    store = prn.PermanentNumbers(spark, str(tmp_path / "s"))
    assert sample(spark, store, configs) == set()
    store.insert(spark.createDataFrame([(None, 1), ("a", 5), ("a", 2), ("a", None)], "relative STRING, batch_no INT"), "relative", "batch_no")
    assert [tuple(r)[::2] for r in store.read().collect()] == [("a", 2)]
    assert prn.select(store.read(), store.thresholds(configs.limit(0), "config_id")).count() == 0


def test_a_store_outlives_its_object_and_keeps_shares(spark, tmp_path, configs):
    first = prn.PermanentNumbers(spark, str(tmp_path / "s"), buckets=3)
    first.insert(records(spark, 0, 200), "relative", "batch_no")
    before = sample(spark, first, configs)
    spark.sql(f"DROP TABLE {first.table}")
    later = prn.PermanentNumbers(spark, str(tmp_path / "s"))
    assert later.buckets == 3 and later.read().count() == 200
    later.insert(records(spark, 100, 300), "relative", "batch_no")
    assert later.read().count() == later.read().select("id").distinct().count() == 300
    smaller = configs.withColumn("sample_share", F.col("sample_share") / 2)
    assert before <= sample(spark, later, smaller)
    plan = later.read().select("id").join(spark.range(9).selectExpr("cast(id as string) id").repartition(3, "id"), "id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1, "what is stored is not shuffled"


def test_a_second_writer_gets_a_conflict(spark, tmp_path):
    store = prn.PermanentNumbers(spark, str(tmp_path / "s"))
    with store._claim(), pytest.raises(prn.Conflict):
        store.insert(records(spark, 0, 5), "relative", "batch_no")
    store.insert(records(spark, 0, 5), "relative", "batch_no")
    assert store.read().count() == 5


def test_any_number_of_configurations(spark, tmp_path):
    store = prn.PermanentNumbers(spark, str(tmp_path / "s"))
    store.insert(records(spark, 0, 60), "relative", "batch_no")
    many = spark.range(2500).selectExpr("id AS config_id", "id % 7 AS seed", "0.3 AS sample_share")
    limits = store.thresholds(many, "config_id")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(prn.select(store.read(), limits)) == rows(prn.select(store.read(), limits, block=5000))
