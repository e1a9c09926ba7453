import datetime

import numpy as np
import pytest

from patchloom.llm import digest, queries
from patchloom.session import join_small

PS = [0.01, 0.25, 0.5, 0.75, 0.99]


def rank_error(values, value, p):
    values = np.sort(values)
    low, high = np.searchsorted(values, value, "left") / len(values), np.searchsorted(values, value, "right") / len(values)
    return max(0.0, p - high, low - p)


@pytest.mark.parametrize("kind", ["normal", "tail", "ties", "few", "one"])
def test_clusters_keep_weight_and_stay_small(kind):
    rng = np.random.default_rng(1)
    values = {"normal": rng.normal(size=50_000), "tail": rng.pareto(0.5, 50_000), "ties": rng.integers(0, 5, 50_000).astype(float), "few": rng.normal(size=5), "one": np.array([3.0])}[kind]
    n = len(values)
    code = np.zeros(n, np.int64)
    one = digest.cluster(code, values, np.ones(n), values, values)
    assert one[2].sum() == n and len(one[1]) <= digest.DELTA + 2 and (np.diff(one[1]) >= 0).all()
    assert one[2].max() <= max(1, n * np.pi / digest.DELTA)
    halves = [digest.cluster(code[s], values[s], np.ones(len(code[s])), values[s], values[s]) for s in (slice(0, n // 2), slice(n // 2, n))]
    both = digest.cluster(*[np.concatenate(x) for x in zip(*halves)])
    assert both[2].sum() == n and both[3].min() == values.min() and both[4].max() == values.max()


def test_groups_are_apart():
    code = np.array([1, 0, 1, 0])
    out = digest.cluster(code, np.array([5.0, 1.0, 7.0, 3.0]), np.ones(4), np.array([5.0, 1.0, 7.0, 3.0]), np.array([5.0, 1.0, 7.0, 3.0]))
    assert out[0].tolist() == [0, 0, 1, 1] and out[1].tolist() == [1, 3, 5, 7]


def table(spark, parts=6):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g, n in (("hot", 8000), ("warm", 900), ("cold", 7), (None, 50)) for v in rng.lognormal(1, 2, n).round(2) + 0.01]
    rows += [("hot", bad) for bad in (None, float("nan"), float("inf"), 0.0, -1.0)] + [("none", None)]
    return rows, spark.createDataFrame(rows, "g STRING, value DOUBLE").repartition(parts)


def test_percentiles_are_certified_exactly(spark):
    rows, df = table(spark)
    d = digest.build(df, ["g"], "value")
    out = digest.certify(df, [(["g"], digest.estimate(d, ["g"], PS))], "value", PS)[0].collect()
    assert {r["g"] for r in out} == {"hot", "warm", "cold", None}
    for r in out:
        values = [v for g, v in rows if g == r["g"] and v is not None and 0 < v < float("inf")]
        assert r["n"] == len(values)
        assert r["rank_error"] == pytest.approx(rank_error(values, r["value"], r["p"]), abs=1e-12)
        assert r["rank_error"] <= r["bound"] < 1 / len(values) + 0.01 and r["within_bound"]


def test_days_merge_to_the_whole(spark):
    rng = np.random.default_rng(5)
    rows = [(datetime.date(2026, 1, 1 + i % 5), float(v)) for i, v in enumerate(rng.gamma(2, 10, 5000))]
    df = spark.createDataFrame(rows, "day DATE, value DOUBLE").repartition(9)
    days = digest.build(df, ["day"], "value")
    for r in digest.certify(df.selectExpr("'all' everything", "value"), [(["everything"], digest.estimate(digest.merge(days, []), ["everything"], PS))], "value", PS)[0].collect():
        assert r["n"] == 5000 and r["rank_error"] < 0.01


def test_levels_are_certified_in_one_pass_as_each_alone(spark):
    rng = np.random.default_rng(6)
    rows = [(["a", "b", None][int(rng.integers(3))], int(rng.integers(4)), float(rng.gamma(2, 10))) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g STRING, day INT, value DOUBLE").repartition(5)
    days = digest.build(df, ["g", "day"], "value").cache()
    fine, coarse = (["g", "day"], digest.estimate(days, ["g", "day"], PS).cache()), (["g"], digest.estimate(digest.merge(days, ["g"]), ["g"], PS).cache())
    rows_of = lambda x: sorted(str(r) for r in x.collect())
    together = digest.certify(df, [fine, coarse], "value", PS)
    assert [rows_of(x) for x in together] == [rows_of(digest.certify(df, [level], "value", PS)[0]) for level in (fine, coarse)]
    assert together[1].count() == 3 * len(PS)


def test_a_coarse_clock_keeps_the_stated_bound(spark):
    """Beside values that a tenth of the rows share, a value just next to them has a rank far off."""
    rng = np.random.default_rng(8)
    exact = rng.normal(230, 60, 300_000).clip(40)
    values = np.where(rng.random(300_000) < 0.85, np.maximum(15.625, (exact / 15.625).round() * 15.625), (exact / 7.8125).round() * 7.8125 + 0.2)
    rows = [(int(g), int(h), float(v)) for g, h, v in zip(rng.integers(0, 5, 300_000), rng.integers(0, 25, 300_000), values)]
    df = spark.createDataFrame(rows, "g INT, day INT, value DOUBLE").repartition(7).cache()
    days = digest.build(df, ["g", "day"], "value").cache()
    levels = [(["g", "day"], digest.estimate(days, ["g", "day"], queries.PERCENTILES)), (["g"], digest.estimate(digest.merge(days, ["g"]), ["g"], queries.PERCENTILES))]
    for out, groups in zip(digest.certify(df, levels, "value", queries.PERCENTILES), (125, 5)):
        found = out.collect()
        assert len(found) == groups * 7 and not [r for r in found if not r["within_bound"]]


def test_empty(spark):
    df = spark.createDataFrame([], "g STRING, value DOUBLE")
    d = digest.build(df, ["g"], "value")
    assert d.count() == 0 and digest.certify(df, [(["g"], digest.estimate(d, ["g"], PS))], "value", PS)[0].count() == 0


def test_a_side_too_large_to_broadcast_is_salted(spark):
    big, small = spark.range(100).selectExpr("id % 10 k", "id v"), spark.range(10).selectExpr("id k", "id * 2 w")
    for limit in (1, 100):
        out = join_small(big, small, ["k"], limit=limit)
        assert sorted(tuple(r) for r in out.collect()) == [(k, v, 2 * k) for k, v in sorted((i % 10, i) for i in range(100))]


def test_benchmark_values_of_unknown_status_count(spark, tmp_path):
    rows = [(1, "ok", 10.0, 20.0), (2, None, 11.0, 21.0), (3, None, 0.0, 22.0), (4, "failed", 12.0, 23.0), (5, "oom", None, 24.0), (6, " OK", None, 25.0)]
    df = spark.createDataFrame([(i, s, "scaling", 100, 100 / t if t else None, t, m) for i, s, t, m in rows], "bench_id BIGINT, status STRING, stage STRING, images_processed BIGINT, elapsed_seconds DOUBLE, throughput_images_per_sec DOUBLE, maskcut_ms_image DOUBLE")
    df.write.parquet(str(tmp_path / "benchmark_runs.parquet"))
    found = sorted((r["metric"], r["value"]) for r in queries._bench(spark, str(tmp_path)).collect())
    assert found == [("maskcut_ms_image", v) for v in (20.0, 21.0, 22.0, 25.0)] + [("throughput_images_per_sec", v) for v in (10.0, 11.0)]
