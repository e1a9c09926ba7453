import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.operators import catalog, fewshot, monitor, pca, planner, receipts, roi, spectral


def test_roi_weights_cells_by_cover(spark):
    cells = [(1, 2, 2, r, c, [float(r * 2 + c), 1.0]) for r in range(2) for c in range(2)]
    f = spark.createDataFrame(cells, "image INT, rows INT, cols INT, r INT, c INT, vec ARRAY<DOUBLE>")
    boxes = spark.createDataFrame([(1, 0, 0.25, 0.25, 0.5, 0.5), (1, 1, 0.5, 0.5, 1.0, 1.0), (1, 2, 0.5, 0.25, 0.5, 0.5)], "image INT, ord INT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE")
    assert {r["ord"]: r["vec"] for r in roi.pool(f, boxes).collect()} == {0: [0.0, 1.0], 1: [1.5, 1.0], 2: [0.5, 1.0]}
    bad = spark.createDataFrame([(1, 0, 0.5, 0.5, 0.0, 1.0)], boxes.schema)
    with pytest.raises(Exception, match="no size"):
        roi.pool(f, bad).collect()
    off = spark.createDataFrame([(1, 0, 2.0, 2.0, 0.1, 0.1)], boxes.schema)
    with pytest.raises(ValueError):
        roi.require_overlap(off, roi.pool(f, off))


def test_prototypes_and_gate(spark):
    support = spark.createDataFrame([("a", [2.0, 0.0]), ("a", [0.0, 5.0]), ("b", [0.0, -1.0])], "cls STRING, vec ARRAY<DOUBLE>")
    p = {r["cls"]: r["vec"] for r in fewshot.prototypes(support).collect()}
    assert np.allclose(p["a"], [2**-0.5, 2**-0.5]) and np.allclose(p["b"], [0, -1])
    q = spark.createDataFrame([(1, [3.0, 3.0]), (2, [1.0, -1.0])], "id INT, vec ARRAY<DOUBLE>")
    m = {r["id"]: r for r in fewshot.match(fewshot.scores(q, fewshot.prototypes(support)), threshold=0.8).collect()}
    assert m[1]["label"] == "a" and m[2]["label"] == "unknown" and m[2]["top1"] == "b"
    alone = fewshot.match(fewshot.scores(q, fewshot.prototypes(support.where("cls = 'b'"))))
    assert {r["margin"] for r in alone.collect()} == {2.0}
    with pytest.raises(ValueError):
        fewshot.match(q, threshold=2)
    with pytest.raises(Exception, match="direction"):
        fewshot.prototypes(spark.createDataFrame([("a", [0.0, 0.0])], support.schema)).collect()


def test_ties_go_to_the_least_class_and_misses_count(spark):
    scored = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (2, "b", 0.9), (2, "a", 0.1)], "id INT, cls STRING, cosine DOUBLE")
    m = fewshot.match(scored)
    assert {r["id"]: (r["top1"], round(r["margin"], 9)) for r in m.collect()} == {1: ("a", 0.0), 2: ("b", 0.8)}
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id INT, cls STRING")
    t = {r["cls"]: (r["total"], r["found"], r["correct"]) for r in fewshot.tally(m, truth).collect()}
    assert t == {"a": (2, 2, 1), "b": (1, 0, 0)}
    assert fewshot.overall(fewshot.tally(m, truth)).collect()[0]["macro_recall"] == 0.25


def test_subset_ignores_the_order_of_rows(spark):
    names = [f"d/{i}.jpg" for i in range(40)]
    want = sorted(names, key=lambda n: (hashlib.sha256(f"7:{n}".encode()).hexdigest(), n))[:5]
    for rows in (names, names[::-1]):
        df = spark.createDataFrame([(n,) for n in rows], "relative STRING").repartition(3)
        s = catalog.deterministic_subset(df, 5, 7)
        assert [r["relative"] for r in s.orderBy("rank").collect()] == want
    assert catalog.subset_digest(s).collect()[0]["digest"] == hashlib.sha256("\n".join(want).encode()).hexdigest()
    assert catalog.deterministic_subset(df, 100, 7).count() == 40


def test_scan_manifest_and_collisions(spark, tmp_path):
    for name in ("b/x.JPG", "a/y.png", "a/y.txt", "z.jpeg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"123")
    found = catalog.scan(spark, str(tmp_path))
    assert sorted((r["relative"], r["size"], r["key"]) for r in found.collect()) == [("a/y.png", 3, "a/y.txt"), ("b/x.JPG", 3, "b/x.txt"), ("z.jpeg", 3, "z.txt")]
    listed = lambda *names: spark.createDataFrame(list(enumerate(names)), "ord INT, relative STRING")
    assert [r["relative"] for r in catalog.from_manifest(found, listed("z.jpeg", "a/y.png")).collect()] == ["z.jpeg", "a/y.png"]
    for names, what in [(("../z.jpeg",), "unsafe"), (("/z.jpeg",), "unsafe"), (("q.jpg",), "missing"), (("z.jpeg", "z.png"), "named twice"), (("a/y.txt",), "unsafe")]:
        with pytest.raises(Exception, match=what):
            catalog.from_manifest(found, listed(*names)).collect()
    both = spark.createDataFrame([("a/x.jpg",), ("a/x.png",), ("a/x.png",), ("b/x.png",)], "relative STRING")
    assert [tuple(r) for r in catalog.collisions(both).collect()] == [("a/x.txt", 2)]
    with pytest.raises(ValueError):
        catalog.require_rows(found.limit(0), "no images")
    with pytest.raises(Exception, match="no split"):
        both.select(catalog.route(F.col("relative"), {"a": "train"})).collect()


def test_labels_round_trip_and_reject(spark):
    boxes = [(0.375, 0.5, 0.125, 0.75), (1 / 3, 1 / 3, 1 / 7, 1 / 9)]
    df = spark.createDataFrame([([{"x": b[0], "y": b[1], "w": b[2], "h": b[3]} for b in boxes],), ([],)], "bs ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>>")
    out = df.select(receipts.encode_labels(F.col("bs")).alias("t")).select("t", receipts.decode_labels(F.col("t")).alias("b"), F.sha2(F.col("t").cast("binary"), 256).alias("s")).collect()
    assert out[0]["t"].splitlines()[0] == "0 0.37500000 0.50000000 0.12500000 0.75000000" and len(out[0]["b"]) == 2
    assert out[0]["s"] == receipts.label_digest(boxes) and out[1]["b"] == []
    bad = ["1 .5 .5 .1 .1", "0 .5 .5 .1", "0 .5 .5 0 .1", "0 nan .5 .1 .1", "0 .5 .5 1.5 .1", "0 .01 .5 .5 .1", "0 .5 .5 .1 .1\n\n0 .5 .5 .1 .1", "x"]
    df = spark.createDataFrame([(b,) for b in bad], "t STRING")
    assert all(r["b"] is None for r in df.select(receipts.decode_labels(F.col("t")).alias("b")).collect())


def test_resume_redoes_what_does_not_agree(spark):
    names = ["ok", "zero", "size", "label", "count", "none"]
    records = spark.createDataFrame([(n, 10, 5, 64, 48, "" if n == "zero" else "0 0.5 0.5 0.1 0.1\n") for n in names], "relative STRING, size BIGINT, mtime_ns BIGINT, width INT, height INT, label STRING")
    r = receipts.receipts(records.where("relative <> 'none'"), "f", "/d")
    r = r.withColumn("source_size", F.expr("if(image = 'size', 11, source_size)")).withColumn("boxes", F.expr("if(image = 'count', 2, boxes)"))
    labels = records.select(F.col("relative").alias("image"), F.expr("if(relative = 'label', '0 0.5 0.5 0.2 0.1\n', label)").alias("label"))
    done = receipts.valid(records, r, labels, "f", "/d")
    assert sorted(x["relative"] for x in receipts.todo(records, done).collect()) == ["count", "label", "none", "size"]
    assert receipts.todo(records, receipts.valid(records, r, labels, "other", "/d")).count() == 6
    with pytest.raises(ValueError):
        receipts.require_complete(records, done)


def test_planning(spark):
    runs = spark.createDataFrame([(1, 8, "ok", 5.0), (1, 8, "ok", 4.0), (2, 8, "ok", 9.0), (2, 8, "ok", 1.0), (4, 8, "oom", 20.0), (4, 8, "ok", 20.0), (8, 8, "ok", 30.0)], "workers INT, batch INT, status STRING, throughput DOUBLE")
    c = planner.candidates(runs, 2)
    assert {r["workers"]: r["ok"] for r in c.collect()} == {1: True, 2: True, 4: False, 8: False}
    assert planner.choose_best(c, 0.75).collect()[0]["workers"] == 1
    assert planner.choose_best(c, 0.95).count() == 0
    e = spark.createDataFrame([(10.0, 864_000), (10.0, 864_001), (0.0, 5), (5.0, None)], "r DOUBLE, n BIGINT")
    out = [tuple(r) for r in e.select(*planner.estimate(F.col("r"), F.col("n"))).collect()]
    assert out[0] == (24.0, "PASS") and out[1][1] == "FAIL" and out[2] == (None, "FAIL") and out[3] == (None, "NOT MEASURED")
    groups = spark.createDataFrame([("a", 148_000_000), ("b", 10_000), ("c", 148_000_000_000)], "name STRING, size BIGINT")
    plan = {r["name"]: r["take_bytes"] for r in planner.allocate(groups, 99_000_000_000, F.col("name") == "b").collect()}
    share = (99_000_000_000 - 10_000) * 148_000_000 // 148_148_000_000
    assert plan["b"] == 10_000 and plan["a"] == (share + 511) // 512 * 512 - 512 and plan["c"] < 148_000_000_000
    with pytest.raises(ValueError):
        planner.require_plan(planner.allocate(groups, 20_000, F.lit(False)))
    assert planner.worker_limit(8, 8, 16 << 30) == 7 and planner.worker_limit(8, 8, 1 << 30) == 1 and planner.worker_limit(8, 4, 64 << 30, 2) == 2
    assert planner.worker_candidates([], 6) == [1, 2, 4, 6] and planner.worker_candidates([9, 2, 2], 6) == [2]
    assert planner.choose_mode(1e9, 10**12, 10**14) == "full" and planner.choose_mode(1e3, 10**12, 10**14) == "100gb" and planner.choose_mode(1e3, 1, 0, "full") == "full"
    entries = [(0, "a", 0, 5, 5), (1, "b", 5, 6, 6)]
    p, i = spark.createDataFrame(entries, "ord INT, name STRING, offset INT, size INT, take_bytes INT"), spark.createDataFrame([e[:4] for e in entries], "ord INT, name STRING, offset INT, size INT")
    assert planner.same_plan(p, i).collect()[0][0] and not planner.same_plan(p, i.limit(1)).collect()[0][0]
    r, f = spark.createDataFrame([("a", 2, 10), ("b", 1, 5)], "name STRING, images INT, image_bytes INT"), spark.createDataFrame([("a", 4), ("a", 6)], "name STRING, size INT")
    assert {x["name"]: x["done"] for x in planner.group_done(r, f).collect()} == {"a": True, "b": False}


def test_rolling_rates_agree_with_a_queue(spark):
    rng = np.random.default_rng(3)
    times = np.sort(rng.integers(0, 1000, 60)).tolist()
    samples = list(dict.fromkeys(times))
    df = spark.createDataFrame([(t, i) for i, t in enumerate(samples)], "t_us BIGINT, n BIGINT")
    out = {r["t_us"]: (r["base_t"], r["base_n"]) for r in monitor.rolling(df, 100, total=99).collect()}
    queue = []
    for i, t in enumerate(samples):
        queue.append((t, i))
        while len(queue) > 2 and queue[1][0] < t - 100:
            queue.pop(0)
        base = queue[0] if queue[0][0] < t - 100 or queue[0] == (samples[0], 0) else None
        if base:
            assert out[t] == base


def test_images_with_bad_features_do_not_fail_others(spark):
    good = [(1, 4, 4, r, c, [1.0, 0.0] if 0 < r < 3 and 0 < c < 3 else [0.0, 1.0]) for r in range(4) for c in range(4)]
    bad = [(2, 4, 4, r, c, [float("nan"), 0.0]) for r in range(4) for c in range(4)]
    f = spark.createDataFrame(good + bad, "image BIGINT, rows INT, cols INT, r INT, c INT, vec ARRAY<DOUBLE>")
    out = spectral.masks(f, spectral.CutSettings(max_objects=1)).collect()
    assert sorted((r["r"], r["c"]) for r in out if r["image"] == 1) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert [r["error"] for r in out if r["image"] == 2] == ["features are not finite"]


def test_colours():
    rgb, share = pca.colours(np.random.default_rng(0).normal(size=(64, 16)))
    assert rgb.shape == (64, 3) and rgb.dtype == np.uint8 and 0 < share.sum() <= 1
    assert not pca.colours(np.ones((16, 4)))[0].any()
    with pytest.raises(ValueError):
        pca.colours(np.full((4, 4), np.nan))


def test_positions_in_an_order_need_no_single_task(spark):
    rows = spark.range(1000).selectExpr("1000 - id v", "'x' n0").repartition(7)
    got = {r["v"]: (r["position"], r["n"]) for r in catalog.numbered(rows, ["v"]).collect()}
    assert got == {v: (v - 1, 1000) for v in range(1, 1001)}
    assert sorted((r["v"], r["position"]) for r in catalog.probes(rows, ["v"]).collect()) == [(1, 0), (501, 500), (1000, 999)]
    assert catalog.probes(rows.limit(1), ["v"]).count() == 1 and catalog.probes(rows.limit(0), ["v"]).count() == 0


def test_any_number_of_classes_compares_alike(spark):
    rng = np.random.default_rng(3)
    protos = spark.createDataFrame([(f"c{i:02}", rng.normal(size=4).tolist()) for i in range(30)], "cls STRING, vec ARRAY<DOUBLE>")
    q = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(40)], "id INT, vec ARRAY<DOUBLE>")
    rows = lambda df: sorted(str(r) for r in df.collect())
    assert rows(fewshot.ranked(q, protos)) == rows(fewshot.ranked(q, protos, block=4))
    assert rows(fewshot.match(fewshot.ranked(q, protos))) == rows(fewshot.match(fewshot.ranked(q, protos, block=4, keep=2)))
    assert rows(fewshot.scores(q, protos)) == rows(fewshot.scores(q, protos, block=7))


def test_time_left_of_a_training(spark):
    rows = [(0.0, 0, 0, 4, 0, 10, False), (60.0, 0, 0, 4, 5, 10, False), (120.0, 0, 0, 4, 10, 10, True), (100.0, 2, 3, 4, 1, 0, True), (5.0, 4, 4, 4, 1, 1, True), (9.0, 0, 9, 4, 0, 10, True)]
    df = spark.createDataFrame(rows, "elapsed DOUBLE, start_epoch INT, epoch INT, epochs INT, batch INT, batches INT, ended BOOLEAN")
    assert [(r["share"], r["eta"]) for r in monitor.training_eta(df).collect()] == [(0.0, "?"), (0.125, "00:07:00"), (0.25, "00:06:00"), (1.0, "00:00:00"), (1.0, "00:00:00")]


def test_splits_are_complete_or_not(spark):
    df = spark.createDataFrame([("a/1.jpg",), ("a/2.jpg",), ("a/2.jpg",), ("b/1.jpg",)], "relative STRING")
    assert {(r["split"], r["n"], r["complete"]) for r in catalog.split_complete(df, {"a": 2, "b": 2, "c": 1}).collect()} == {("a", 2, True), ("b", 1, False), ("c", 0, False)}


def test_byte_allocation_when_probes_outgrow_the_budget(spark, tmp_path):
    """F1: at 60 x sf0.1 the probes alone are beyond the budget; every group still gets the SQL's row."""
    from patchloom.plans import core

    spark.createDataFrame([(1, 2_000_000.0), (2, 10.0), (3, 3.0)], "p_partkey BIGINT, p_retailprice DOUBLE").write.parquet(str(tmp_path / "part.parquet"))
    size = {1: 200_001_000_000, 2: 2_000_000, 3: 1_300_000}
    short, rest = size[1] - 100_000_000_000, size[2] + size[3]
    want = {1: size[1]} | {n: -((short * size[n] // rest - 511) // 512 * 512) - 512 for n in (2, 3)}  # divisions cut towards zero
    assert {r["name"]: (r["size"], r["take_bytes"]) for r in core.byte_allocation(spark, str(tmp_path)).collect()} == {n: (size[n], want[n]) for n in size}
    with pytest.raises(ValueError):
        planner.require_plan(core.byte_allocation(spark, str(tmp_path)))
