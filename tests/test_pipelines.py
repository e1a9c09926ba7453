import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom import __main__ as cli
from patchloom import config
from patchloom.plans import pipelines
from patchloom.sources.images import HashBackbone, HashDual

from .test_io import png

SETTINGS = config.parse({"features": {"resolution": 64}, "masks": {"max_objects": 1}})


class Planted:
    """One object in the middle of every image but black ones, which are uniform."""

    grid = (8, 8)

    def extract(self, batch):
        out = np.zeros((len(batch), 64, 2), np.float32)
        out[:, :, 0] = 1
        middle = np.zeros((8, 8), bool)
        middle[2:6, 2:6] = True
        bright = batch.mean(axis=(1, 2, 3)) > -1
        out[np.ix_(bright, middle.ravel())] = [0, 1]
        return out


@pytest.fixture
def folder(tmp_path):
    for i in range(5):
        path = tmp_path / "in" / ("train2017" if i < 3 else "val2017") / f"{i}.png"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(png(32, 16, (0, 0, 0) if i == 4 else (200, 100, 50 + i)))
    return tmp_path


def run(spark, folder, settings=SETTINGS):
    return pipelines.generate(spark, str(folder / "in"), str(folder / "out"), settings, Planted)["runs"][0]


def test_generate_resumes_and_redoes_only_what_changed(spark, folder):
    (folder / "in/train2017/broken.png").write_bytes(b"no picture")
    first = run(spark, folder)
    assert (first["images_processed"], first["images_failed"], first["images_skipped"]) == (5, 1, 0)
    assert first["quality"]["valid_images"] == 5 and first["quality"]["total_boxes"] >= 4
    (folder / "in/train2017/broken.png").unlink()
    assert run(spark, folder)["images_skipped"] == 5
    (folder / "in/train2017/0.png").write_bytes(png(32, 16, (9, 200, 30)) + b" ")
    again = run(spark, folder)
    assert (again["images_processed"], again["images_skipped"]) == (1, 4)
    assert again["quality"]["valid_images"] == 5
    other = run(spark, folder, replace(SETTINGS, masks=replace(SETTINGS.masks, tau=0.3)))
    assert other["images_processed"] == 5, "other settings, other labels"
    label = spark.read.parquet(str(folder / "out/labels")).where("image = 'train2017/1.png'").collect()[0]["label"]
    assert label == "0 0.50000000 0.50000000 0.50000000 0.50000000\n"
    shown = pipelines.preview(spark, str(folder / "in"), str(folder / "out"), SETTINGS, 10).collect()
    assert len(shown) == 5 and shown[0]["n_boxes"] >= shown[-1]["n_boxes"]
    routes = {"train2017": "train", "val2017": "val"}
    counts = pipelines.prepare_training(spark, str(folder / "in"), str(folder / "out"), SETTINGS, str(folder / "t"), routes)
    assert {r["split"]: r["images"] for r in counts.collect()} == {"train": 3, "val": 2}
    assert (folder / "t/labels/train/train2017/1.txt").read_text() == label and (folder / "t/images/val/val2017/3.png").resolve() == (folder / "in/val2017/3.png").resolve()
    assert all((folder / "t/images" / r["value"].split("/images/")[1]).exists() for r in spark.read.text(str(folder / "t/lists")).collect())
    (folder / "in/val2017/torn.jpg").write_bytes(b"\xff\xd8 no end")
    with pytest.raises(ValueError, match="no valid label"):
        pipelines.prepare_training(spark, str(folder / "in"), str(folder / "out"), SETTINGS, str(folder / "t"), routes)
    (folder / "in/val2017/torn.jpg").unlink()
    assert [r["relative"] for r in pipelines.catalog.scan(spark, str(folder / "in/val2017/3.png")).collect()] == ["3.png"]
    (folder / "in/train2017/new.png").write_bytes(png(8, 8, (1, 2, 3)))
    with pytest.raises(ValueError, match="no valid label"):
        pipelines.prepare_training(spark, str(folder / "in"), str(folder / "out"), SETTINGS, str(folder / "t"), routes)


def test_a_label_that_changed_counts_once(spark, folder):
    run(spark, folder)
    (folder / "in/train2017/0.png").write_bytes(png(64, 16, (0, 0, 0)) + b" ")
    again = run(spark, folder)
    assert again["images_processed"] == 1
    records = pipelines.catalog.scan(spark, str(folder / "in"))
    boxes, images = pipelines.stored_boxes(spark, str(folder / "out"), records, SETTINGS.fingerprint("none"), str(folder / "in"))
    per = {r["image"]: (r["width"], r["height"]) for r in images.collect()}
    assert images.count() == 5 and per["train2017/0.png"] == (64.0, 16.0)
    labels = spark.read.parquet(str(folder / "out/labels")).where("image = 'train2017/0.png'").select("label").distinct()
    assert labels.count() == 2, "its label differs from the old one"
    assert boxes.groupBy("image").count().where("count > 1").count() == 0


def test_only_what_is_left_is_decoded(spark, folder, monkeypatch):
    run(spark, folder)
    (folder / "in/val2017/new.png").write_bytes(png(8, 8, (9, 90, 9)))
    asked = []
    pixels = pipelines.image_source._pixels
    monkeypatch.setattr(pipelines.image_source, "_pixels", lambda s, sources, want: asked.extend(sources) or pixels(s, sources, want))
    assert run(spark, folder)["images_processed"] == 1
    assert [x.rsplit("/", 1)[1] for x in asked] == ["new.png"]


def test_dataset_and_output_stay_apart(spark, folder):
    with pytest.raises(ValueError):
        pipelines.generate(spark, str(folder / "in"), str(folder / "in/out"), SETTINGS, Planted)


def test_compare_sweep_benchmark_and_colours(spark, folder):
    root = str(folder / "in")
    small = replace(SETTINGS, filtering=replace(SETTINGS.filtering, max_box_area=0.2))
    rows = pipelines.compare(spark, root, SETTINGS, small, 4, Planted).collect()
    assert len(rows) == 4 and all(r["change"] == r["b_boxes"] - r["a_boxes"] for r in rows) and any(r["change"] < 0 for r in rows)
    f, sizes = pipelines.features_of(spark, root, pipelines.catalog.scan(spark, root), SETTINGS, Planted)
    assert pipelines.tau_sweep(spark, f, sizes, SETTINGS, [0.5, 0.9], (8, 8)).count() == 10
    s = replace(SETTINGS, benchmark=config.Benchmark(repeats=1, batch_sizes=(2,), worker_counts=(1, 2), min_stability_ratio=0.01))
    b = pipelines.benchmark(spark, root, s, 5, HashBackbone)
    assert b["best"]["workers"] in (1, 2) and len(b["candidates"]) == 2 and not b["qualified"]
    assert pipelines.key_preview(spark, root, SETTINGS, 2, Planted).count() == 128


def quick(**more):
    return replace(SETTINGS, benchmark=config.Benchmark(smoke_images=2, scaling_images=3, confirmation_images=5, repeats=1, worker_counts=(1,), min_stability_ratio=0.01, **more))


class Small(Planted):
    """Its memory holds three images."""

    def extract(self, batch):
        if len(batch) > 2:
            raise RuntimeError("CUDA out of memory")
        return super().extract(batch)


def test_benchmark_trials_do_the_whole_job(spark, folder):
    b = pipelines.benchmark(spark, str(folder / "in"), quick(batch_sizes=(3, 2)), None, Small)
    assert [(r["stage"], r["batch_size"], r["status"], r["images_processed"], r["labelled"]) for r in b["runs"]] == [("smoke", 1, "ok", 2, 2), ("scaling", 2, "ok", 3, 3), ("scaling", 3, "oom", 0, 0), ("confirmation", 2, "ok", 5, 5)]
    assert b["runs"][-1]["quality"]["total_boxes"] >= 4 and not b["qualified"] and b["best"]["batch"] == 2
    assert b["estimate"]["hours"] == pytest.approx(5 / b["runs"][-1]["throughput_images_per_sec"] / 3600)


def test_benchmark_fails_with_its_images(spark, folder):
    for i in range(5):
        (folder / "in/train2017" / f"broken{i}.png").write_bytes(b"no picture")
    with pytest.raises(RuntimeError, match="images failed"):
        pipelines.benchmark(spark, str(folder / "in"), replace(quick(batch_sizes=(2,)), benchmark=replace(quick().benchmark, smoke_images=10)), None, Planted)


def test_matching_and_localisation(spark):
    rows = [(i, 2, 2, r, c, [1.0, 0.0] if (c == 0) == (i != "b") else [0.0, 1.0]) for i in ("a", "b", "q") for r in range(2) for c in range(2)]
    f = spark.createDataFrame(rows, "image STRING, rows INT, cols INT, r INT, c INT, vec ARRAY<DOUBLE>")
    left = spark.createDataFrame([("q", 0, 0.25, 0.5, 0.5, 1.0), ("q", 1, 0.75, 0.5, 0.5, 1.0)], "image STRING, ord INT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE")
    f = f.withColumn("vec", F.when(F.col("image") == "a", F.array(F.lit(1.0), F.lit(0.1))).when(F.col("image") == "b", F.array(F.lit(0.1), F.lit(1.0))).otherwise(F.col("vec")))
    matched = pipelines.match_images(f, spark.createDataFrame([("a", "A"), ("b", "B")], "image STRING, cls STRING"), left)
    assert {r["ord"]: r["label"] for r in matched.collect()} == {0: "A", 1: "B"}
    pairs = spark.createDataFrame([("q", 0, 0), ("q", 1, 1)], "image STRING, p INT, r INT")
    truth = spark.createDataFrame([("q", 0, "A"), ("q", 1, "A"), ("q", 2, "B")], "image STRING, ord INT, cls STRING")
    out = pipelines.localisation(matched, pairs, truth).collect()[0]
    assert (out["reference"], out["localized"], out["correct"], out["macro_recall"]) == (3, 2, 1, 0.25)


def test_predictions_keep_images_without_any(spark, folder):
    box = "named_struct('x', 0.5D, 'y', 0.5D, 'w', 0.1D, 'h', 0.1D)"
    detect = lambda images: images.selectExpr("relative image", "0 ord", "1 class_id", "'dog' label", "if(relative LIKE 'val%', 0.9D, 0.1D) confidence", f"{box} box")
    assert pipelines.predict(spark, str(folder / "in"), str(folder / "p"), detect, 0.5, limit=4) == 4
    assert sorted(r["n_boxes"] for r in spark.read.json(str(folder / "p")).collect()) == [0, 0, 0, 1]


def test_command_line(tmp_path, capsys):
    assert cli.main(["doctor"]) == 0 and json.loads(capsys.readouterr().out)["workers"] >= 1
    (tmp_path / "c.toml").write_text("[nothing]\n")
    assert cli.main(["doctor", "--config", str(tmp_path / "c.toml")]) == 1


def detector(images):
    return images.selectExpr("relative image", "0 ord", "1 class_id", "'dog' label", "0.9D confidence", "named_struct('x', 0.5D, 'y', 0.5D, 'w', 0.1D, 'h', 0.1D) box")


def test_commands_of_seams(spark, folder, capsys):
    (folder / "c.toml").write_text("[dino]\nresolution = 64\n[maskcut]\nmax_objects = 1\n")
    common = ["--dataset", str(folder / "in"), "--output", str(folder / "w"), "--config", str(folder / "c.toml")]
    here = __name__
    assert cli.main(["generate", *common, "--model", f"{here}:Planted"]) == 0
    assert cli.main(["train", *common, "--route", "train2017=train", "--route", "val2017=val"]) == 0
    assert cli.main(["predict", *common, "--detector", f"{here}:detector", "--limit", "3"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"images": 3}
    assert cli.main(["ablation", *common, "--model", f"{here}:Planted", "--variant", f"a={folder / 'c.toml'}"]) == 0
    assert cli.main(["predict", *common, "--detector", "nowhere:x"]) == 1


class Dual(Planted):
    def extract_both(self, batch):
        return {"keys": self.extract(batch), "tokens": np.ones((len(batch), 64, 3), np.float32)}


class Broken(Dual):
    def extract_both(self, batch):
        return super().extract_both(batch) | {"tokens": np.full((len(batch), 64, 3), np.nan)}


def test_backbones_are_compared_and_timed(spark, folder):
    (folder / "in/train2017/broken.png").write_bytes(b"no picture")
    rows, means = pipelines.compare_backbones(spark, str(folder / "in"), str(folder / "o"), SETTINGS, {"a": Dual, "b": HashDual, "c": Broken}, 10, 2)
    found = rows.collect()
    assert {(r["model"], r["image"][-5:]) for r in found if r["error"] == "cannot be decoded"} == {(m, "n.png") for m in "abc"}
    assert sum(r["error"] is None for r in found) == 2 * 5 * 2 and sum(r["model"] == "c" for r in found) == 6
    by = {r["model"]: r for r in means.collect()}
    assert by["a"]["n"] == 5 and by["a"]["forward_ms"] >= 0 and 0.8 <= by["a"]["key_boxes"] <= 1 and set(by) == {"a", "b"}
    saved = spark.read.csv(str(folder / "o/timings"), header=True)
    assert saved.columns == pipelines.files.TIMINGS and saved.count() == 10


def test_ablation_over_shared_features_and_masks_of_a_seam(spark, folder):
    root = str(folder / "in")
    f, sizes = pipelines.features_of(spark, root, pipelines.catalog.scan(spark, root), SETTINGS, Planted)
    small = replace(SETTINGS, filtering=replace(SETTINGS.filtering, max_box_area=0.2))
    out = {(r["variant"], r["n"]) for r in pipelines.ablation(spark, f, sizes, {"now": SETTINGS, "small": small}, (8, 8)).groupBy("variant").agg(F.sum("n_boxes").alias("n")).collect()}
    assert ("small", 0) in {(v, min(n, 0)) for v, n in out} and len(out) == 2 and dict(out)["now"] > dict(out)["small"]

    def annotate(images):
        each = "inline(array(named_struct('ord', 0, 'predicted_iou', 0.85D, 'x', 0.5D), named_struct('ord', 1, 'predicted_iou', 0.99D, 'x', 0.51D), named_struct('ord', 2, 'predicted_iou', 0.7D, 'x', 0.2D)))"
        return images.selectExpr("relative image", each, "0.96D stability", "0.5D y", "0.2D w", "0.5D h", "2.0D seconds")

    per, totals = pipelines.compare_masks(spark, root, SETTINGS, annotate, 4, Planted)
    t = {r["method"]: r for r in totals.collect()}
    assert per.count() == 8 and (t["automatic"]["boxes"], t["automatic"]["mean_seconds"], t["automatic"]["images"]) == (4, 2.0, 4)
    assert 3 <= t["spectral"]["boxes"] <= 4 and t["spectral"]["mean_seconds"] > 0


def test_download_resumes_by_group(spark, tmp_path):
    from patchloom.sources import archives, transfer

    from .test_transfer import archive

    data, _ = archive()
    (tmp_path / "a.tar").write_bytes(data)
    path = str(tmp_path / "a.tar")
    index = archives.index(spark.createDataFrame([(path,)], "path STRING")).where("name <> 'n3.tar'")
    go = lambda **k: pipelines.download(spark, index, lambda: transfer.local(path), len(data), "local", str(tmp_path / "i"), str(tmp_path / "o"), 1 << 40, **k)
    assert go(expected=8) | {"image_bytes": 0} == {"groups": 2, "images": 8, "image_bytes": 0, "fetched": 2, "errors": []}
    assert go()["fetched"] == 0 and len(list((tmp_path / "i").rglob("*.JPEG"))) == 8
    with pytest.raises(ValueError, match="expected"):
        go(expected=9)
    whole = archives.index(spark.createDataFrame([(path,)], "path STRING"))
    assert pipelines.download(spark, whole, lambda: transfer.local(path), len(data), "local", str(tmp_path / "i"), str(tmp_path / "o"), 1 << 40)["errors"] == [{"name": "n3.tar", "error": "no whole image"}]


def test_selection_lookup_warmup_and_precision(spark, folder):
    root = folder / "in"
    (root / "selection.txt").write_text("val2017/4.png\ntrain2017/1.png\n")
    assert [r["relative"] for r in pipelines.catalog.scan(spark, str(root)).collect()] == ["val2017/4.png", "train2017/1.png"]
    for bad in ("../x.png\n", "train2017/none.png\n", "train2017/1.png\ntrain2017/1.png\n", "\n"):
        (root / "selection.txt").write_text(bad)
        with pytest.raises(Exception, match="unsafe|missing|twice|names no"):
            pipelines.catalog.scan(spark, str(root)).collect()
    samples = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 1, "w")], "id STRING, version INT, v STRING")
    want = lambda *rows: spark.createDataFrame(list(rows), "id STRING, version INT")
    assert [r["v"] for r in pipelines.catalog.lookup(want(("a", 2)), samples, ["id", "version"]).collect()] == ["y"]
    for row in (("b", 1), ("c", 1)):
        with pytest.raises(Exception, match="sample"):
            pipelines.catalog.lookup(want(row), samples, ["id", "version"]).collect()

    class Half(Planted):
        def __init__(self):
            self.warm = []

        def warmup(self, batch, side):
            self.warm.append((batch, side))

        def extract(self, batch):
            out = super().extract(batch)
            out[0] = np.inf
            return out

        def extract_precise(self, batch):
            return super().extract(batch)

    model = pipelines.image_source.started(Half, 3, 64)
    found = pipelines.image_source.extracted(model, np.ones((2, 3, 64, 64), np.float32))
    assert model.warm == [(3, 64)] and np.isfinite(found).all() and np.array_equal(found[0], found[1])
