"""Whole runs composed of the operators: generate, compare, benchmark, match, prepare training, predict, preview."""

from __future__ import annotations

import functools
import itertools
import time
from collections.abc import Callable
from dataclasses import fields, replace

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom import config
from patchloom.functions import scalars
from patchloom.operators import catalog, fewshot, nms, pca, planner, quality, receipts, roi, spectral
from patchloom.session import cut, scratch
from patchloom.sinks import files
from patchloom.sources import images as image_source
from patchloom.sources import transfer
from patchloom.sources.images import Backbone, HashBackbone

BOX = "STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>"


def cut_settings(s: config.Settings) -> spectral.CutSettings:
    return spectral.CutSettings(**{f.name: getattr(s.masks, f.name) for f in fields(spectral.CutSettings)})


def features_of(spark: SparkSession, root: str, records: DataFrame, s: config.Settings, make: Callable[[], Backbone], batch: int = 16, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(patch features with errors, sizes of the decoded images), in no more than `tasks` tasks if given."""
    decoded = image_source.decoded(spark, root, records)
    decoded = decoded.coalesce(tasks) if tasks else decoded
    return image_source.features(decoded, make, s.features.resolution, batch), decoded.select(F.col("relative").alias("image"), "width", "height", "error")


def boxes_of(features: DataFrame, sizes: DataFrame, s: config.Settings, grid: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(kept boxes, errors of images). Masks come out of one pass per image; all that follows stays in the JVM."""
    whole = features.where("error IS NULL").drop("error")
    cells = cut(spectral.masks(whole, cut_settings(s)), "cells")
    found = nms.mask_boxes(cells.where("error IS NULL AND mask IS NOT NULL"), *grid).withColumnRenamed("mask", "ord")
    f = s.filtering
    fit = nms.filtered(found, sizes.where("error IS NULL").drop("error"), f.min_box_area, f.max_box_area, f.max_aspect_ratio)
    kept = nms.suppress(fit.select("image", "ord", "x", "y", "w", "h"), [F.col("ord")], f.duplicate_iou)
    errors = features.where("error IS NOT NULL").select("image", "error").unionByName(cells.where("error IS NOT NULL").select("image", "error")).distinct()
    return kept, errors


def labels_of(kept: DataFrame, done: DataFrame) -> DataFrame:
    """image, label of each image of `done`; one without boxes has an empty label."""
    per = kept.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("ord", F.struct("x", "y", "w", "h").alias("b")))).alias("bs"))
    boxes = F.coalesce(F.transform("bs", lambda e: e["b"]), F.array().cast(f"array<{BOX}>"))
    return done.select("image").join(per, "image", "left").select("image", receipts.encode_labels(boxes).alias("label"))


def label_images(spark: SparkSession, root: str, left: DataFrame, out: str, s: config.Settings, make: Callable[[], Backbone], fingerprint: str, batch: int = 16, tasks: int | None = None) -> DataFrame:
    """Decode, extract features, cut masks, find boxes, write labels and then receipts of `left`. Returns image, error of those that failed."""
    features, sizes = features_of(spark, root, left, s, make, batch, tasks)
    features, sizes = cut(features, "features"), cut(sizes, "sizes")
    kept, wrong = boxes_of(features, sizes, s, make().grid)
    wrong = cut(wrong, "errors")
    good = sizes.join(wrong, "image", "left_anti")
    labelled = cut(labels_of(kept, good), "labels")
    facts = left.join(good.withColumnRenamed("image", "relative"), "relative").join(labelled.withColumnRenamed("image", "relative"), "relative")
    files.save_labels(labelled, receipts.receipts(facts, fingerprint, root), out)
    return wrong


def generate(spark: SparkSession, root: str, out: str, s: config.Settings, make: Callable[[], Backbone] = HashBackbone, model_digest: str = "none", resume: bool = True) -> dict:
    """Label every image that has no valid label yet. Finished ones are left out before anything is decoded.

    An image that fails is counted and does not stop the others. Returns the run's report, which is written too.
    """
    config.apart(root, out)
    fingerprint = s.fingerprint(model_digest)
    with files.exclusive(f"{out}/lock"):
        began = time.perf_counter()
        records = cut(catalog.require_rows(catalog.scan(spark, root), f"no images in {root}"), "records")
        if clash := catalog.collisions(records).limit(1).collect():
            raise ValueError(f"several images would write {clash[0]['key']}")
        labels, known = files.load_labels(spark, out)
        done = receipts.valid(records, known, labels, fingerprint, root) if resume else records.limit(0)
        left = cut(receipts.todo(records, done), "todo")
        total, todo = records.count(), left.count()
        failed, errors = 0, []
        if todo:
            wrong = label_images(spark, root, left, out, s, make, fingerprint)
            failed = wrong.select("image").distinct().count()
            errors = [r.asDict() for r in wrong.select("image", F.substring("error", 1, 1000).alias("error")).orderBy("image").limit(100).collect()]
        elapsed = time.perf_counter() - began
        new = todo - failed
        run = {"stage": "generate", "repeat": 1, "status": "ok" if not failed else "failed", "images_processed": new, "images_failed": failed, "images_skipped": total - todo}
        run |= {"elapsed_seconds": elapsed, "throughput_images_per_sec": new / elapsed if elapsed else 0.0, "quality": quality_of(spark, out, records, fingerprint, root)}
        payload = {"schema_version": 1, "run_id": config.run_id("generate"), "kind": "generate", "status": run["status"], "runs": [run], "warnings": [], "errors": errors, "errors_truncated": max(0, failed - len(errors))}
        files.save_report(f"{out}/reports/{payload['run_id']}", payload)
        return payload


def stored_boxes(spark: SparkSession, out: str, records: DataFrame, fingerprint: str, root: str) -> tuple[DataFrame, DataFrame]:
    """(boxes, images) of the records with valid labels."""
    labels, known = files.load_labels(spark, out)
    done = receipts.valid(records, known, labels, fingerprint, root).select(F.col("relative").alias("image"), "label_sha256", "image_size")
    # a label written again stands beside the old one: the valid receipt's digest tells which is meant
    text = labels.select("image", "label", F.sha2(F.col("label").cast("binary"), 256).alias("label_sha256")).distinct().join(done, ["image", "label_sha256"])
    images = text.select("image", F.col("image_size")[0].cast("double").alias("width"), F.col("image_size")[1].cast("double").alias("height")).distinct()
    boxes = text.select("image", F.posexplode(receipts.decode_labels(F.col("label"))).alias("ord", "b")).select("image", "ord", "b.*")
    return boxes, images


def quality_of(spark: SparkSession, out: str, records: DataFrame, fingerprint: str, root: str) -> dict:
    boxes, images = stored_boxes(spark, out, records, fingerprint, root)
    freq = cut(quality.frequencies(quality.counts(images, boxes)), "frequencies")
    areas = quality.histogram(boxes, F.col("w") * F.col("h"), quality.AREA_EDGES).orderBy("bin").collect()
    return quality.summary(freq).collect()[0].asDict() | {"area_counts": [r["n"] for r in areas]}


def compare(spark: SparkSession, root: str, a: config.Settings, b: config.Settings, n: int, make: Callable[[], Backbone] = HashBackbone) -> DataFrame:
    """The same deterministic subset under two settings: image, a_boxes, b_boxes, change. Features are made once."""
    subset = cut(catalog.deterministic_subset(catalog.scan(spark, root), n, a.pipeline.seed), "subset")
    features, sizes = features_of(spark, root, subset, a, make)
    features, sizes = cut(features, "features"), cut(sizes, "sizes")
    counts = [quality.counts(sizes.where("error IS NULL"), boxes_of(features, sizes, s, make().grid)[0]) for s in (a, b)]
    return quality.compare(*counts)


def ablation(spark: SparkSession, features: DataFrame, sizes: DataFrame, variants: dict[str, config.Settings], grid: tuple[int, int]) -> DataFrame:
    """variant, image, n_boxes of each of some settings over shared features."""
    parts = []
    for name, s in variants.items():
        kept, _ = boxes_of(features, sizes, s, grid)
        parts.append(quality.counts(sizes.where("error IS NULL"), kept).select(F.lit(name).alias("variant"), "image", "n_boxes"))
    return functools.reduce(DataFrame.unionByName, parts)


def tau_sweep(spark: SparkSession, features: DataFrame, sizes: DataFrame, s: config.Settings, taus: list[float], grid: tuple[int, int]) -> DataFrame:
    """tau, image, n_boxes over shared features."""
    found = ablation(spark, features, sizes, {repr(t): replace(s, masks=replace(s.masks, tau=t)) for t in taus}, grid)
    return found.select(F.col("variant").cast("double").alias("tau"), "image", "n_boxes")


def _boxes_of_masks(masks: list[np.ndarray], width: int, height: int, f: config.Filtering) -> np.ndarray:
    """As nms.mask_boxes, filtered and suppress, of one image's masks in memory."""
    boxes = []
    for m in masks:
        rows, cols = np.flatnonzero(m.any(axis=1)), np.flatnonzero(m.any(axis=0))
        y0, y1, x0, x1 = rows[0] / m.shape[0], (rows[-1] + 1) / m.shape[0], cols[0] / m.shape[1], (cols[-1] + 1) / m.shape[1]
        w, h = x1 - x0, y1 - y0
        aspect = w * width / (h * height)
        if f.min_box_area <= w * h <= f.max_box_area and max(aspect, 1 / aspect) <= f.max_aspect_ratio:
            boxes.append(((x0 + x1) / 2, (y0 + y1) / 2, w, h))
    found = np.array(boxes).reshape(-1, 4)
    return found[nms.keep_in_order(found, np.array([0]), f.duplicate_iou)] if len(found) else found


REPEATS = "model STRING, image STRING, repeat INT, decode_ms DOUBLE, forward_ms DOUBLE, keys_cut_box_write_ms DOUBLE, tokens_cut_box_write_ms DOUBLE, key_boxes INT, token_boxes INT, keys_edges DOUBLE, tokens_edges DOUBLE, error STRING"


def compare_backbones(spark: SparkSession, root: str, out: str, s: config.Settings, makes: dict[str, Callable[[], image_source.DualBackbone]], n: int, repeats: int = 3) -> tuple[DataFrame, DataFrame]:
    """(a row a model, image and repeat; a row a model) of a deterministic subset under several models.

    Each forward pass gives keys and tokens; both are cut into boxes and written as label lines, and every step is timed in
    the task. Means are of the medians over repeats. The medians of each image are saved as CSV, `timings`.
    """
    subset = cut(catalog.deterministic_subset(catalog.scan(spark, root), n, s.pipeline.seed), "subset")
    pixels = cut(image_source.decoded(spark, root, subset), "pixels")
    settings, side = cut_settings(s), s.features.resolution

    def measured(name: str, make: Callable) -> Callable:
        def run(batches):
            model = image_source.started(make, 1, side)
            clock = lambda: time.perf_counter() * 1000
            for frame in batches:
                rows = []
                for r in frame.itertuples():
                    if r.error is not None:
                        rows.append((name, r.relative, None, *[None] * 8, r.error))
                        continue
                    for repeat in range(repeats):
                        began = clock()
                        tensor = image_source.tensor(r.data, int(r.width), int(r.height), int(r.channels), side)
                        decoded = clock()
                        both = model.extract_both(tensor[None])
                        passed = clock()
                        if any(both[k][0].shape[0] != np.prod(model.grid) or not np.isfinite(both[k]).all() for k in ("keys", "tokens")):
                            rows.append((name, r.relative, repeat, *[None] * 8, "features of another shape, or not finite"))
                            break
                        took, boxes, edges = [], [], []
                        for kind in ("keys", "tokens"):
                            start = clock()
                            found = _boxes_of_masks(spectral.discover(both[kind][0], model.grid, settings), r.width, r.height, s.filtering)
                            receipts.label_digest([tuple(b) for b in found.tolist()])
                            took.append(clock() - start)
                            boxes.append(len(found))
                            unit = spectral.directions(both[kind][0].astype(float))
                            cosine = (unit @ unit.T)[~np.eye(len(unit), dtype=bool)]
                            edges.append(float(np.mean(cosine > settings.tau)) if cosine.size else 0.0)
                        rows.append((name, r.relative, repeat, decoded - began, passed - decoded, *took, *boxes, *edges, None))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in REPEATS.split(", ")]).astype({c: "Int32" for c in ("repeat", "key_boxes", "token_boxes")})

        return run

    slim = pixels.select("relative", "width", "height", "channels", "data", "error")
    found = cut(functools.reduce(DataFrame.unionByName, [slim.mapInPandas(measured(k, m), REPEATS) for k, m in makes.items()]), "repeats")
    times = ["decode_ms", "forward_ms", "keys_cut_box_write_ms", "tokens_cut_box_write_ms"]
    ok = found.where("error IS NULL")
    median = ok.groupBy("model", "image").agg(*[F.percentile(t, F.lit(0.5)).alias(t) for t in times], F.max("key_boxes").alias("key_boxes"), F.max("token_boxes").alias("token_boxes"))
    files.save_timings(median, f"{out}/timings")
    return found, planner.median_then_mean(ok, ["model"], ["image"], [*times, "key_boxes", "token_boxes", "keys_edges", "tokens_edges"])


#: What an automatically made mask must reach, and how much two boxes of such may overlap.
MASK_QUALITY, MASK_STABILITY, MASK_OVERLAP = 0.8, 0.95, 0.7


def annotated_boxes(annotations: DataFrame, sizes: DataFrame, f: config.Filtering) -> DataFrame:
    """Kept boxes of automatically made masks: those of quality and stability, the best first, less those that overlap a better one.

    `annotations`: image, ord, predicted_iou, stability, x, y, w, h; `sizes`: image, width, height.
    """
    good = annotations.where((F.col("predicted_iou") >= MASK_QUALITY) & (F.col("stability") >= MASK_STABILITY))
    best = nms.suppress(good, [-F.col("predicted_iou")], MASK_OVERLAP)
    fit = nms.filtered(best, sizes, f.min_box_area, f.max_box_area, f.max_aspect_ratio)
    scored = fit.join(good.select("image", "ord", "predicted_iou"), ["image", "ord"])
    return nms.suppress(scored, [-F.col("predicted_iou")], f.duplicate_iou)


def compare_masks(spark: SparkSession, root: str, s: config.Settings, annotate: Callable[[DataFrame], DataFrame], n: int, make: Callable[[], Backbone] = HashBackbone) -> tuple[DataFrame, DataFrame]:
    """(method, image, n_boxes, seconds; totals of each method) of spectral boxes and those of a seam that makes masks.

    `annotate` gives annotations of decoded images (see `annotated_boxes`) with `seconds`, those of its image; an image it
    finds nothing on is a row of null ord. Spectral seconds are those of the whole job, shared evenly.
    """
    subset = cut(catalog.deterministic_subset(catalog.scan(spark, root), n, s.pipeline.seed), "subset")
    pixels = cut(image_source.decoded(spark, root, subset), "pixels")
    sizes = pixels.where("error IS NULL").select(F.col("relative").alias("image"), "width", "height")
    began = time.perf_counter()
    features = cut(image_source.features(pixels, make, s.features.resolution), "features")
    kept = cut(boxes_of(features, sizes.withColumn("error", F.lit(None).cast("string")), s, make().grid)[0], "kept")
    share = (time.perf_counter() - began) / max(1, subset.count())
    found = cut(annotate(pixels), "annotations")
    seconds = found.groupBy("image").agg(F.max("seconds").alias("seconds"))
    made = quality.counts(sizes, annotated_boxes(found.where("ord IS NOT NULL"), sizes, s.filtering)).join(seconds, "image", "left")
    per = quality.counts(sizes, kept).withColumn("seconds", F.lit(share)).withColumn("method", F.lit("spectral")).unionByName(made.withColumn("method", F.lit("automatic")))
    per = cut(per.select("method", "image", "n_boxes", "seconds"), "methods")
    return per, quality.method_totals(per)


def download(spark: SparkSession, index: DataFrame, transport: Callable[[], transfer.Transport], total: int, etag: str, folder: str, out: str, budget: int, most: int | None = None, expected: int | None = None) -> dict:
    """Fetch the groups of an archive (`index`: name, offset, size) within a budget of bytes, each by its own ranges.

    Groups whose receipt in `out` agrees with the plan are left out; the others are fetched by many tasks. The report says
    how many images there are; of a full download another number than `expected` is an error.
    """
    plan = index.select("name", "offset", "size")
    if budget < plan.agg(F.sum("size")).head()[0]:
        plan = planner.require_plan(planner.allocate(plan, budget, F.lit(False)))
    else:
        plan = plan.withColumn("take_bytes", F.col("size"))
    plan = cut(plan, "plan")
    known = files.load_table(spark, f"{out}/groups", f"{transfer.GROUP}, take_bytes BIGINT, etag STRING")
    done = known.where(F.col("error").isNull() & (F.col("etag") == etag)).select("name", "take_bytes").distinct()
    left = plan.join(done, ["name", "take_bytes"], "left_anti")
    new = cut(transfer.fetch_groups(left, transport, total, etag, folder, most).join(plan.select("name", "take_bytes"), "name").withColumn("etag", F.lit(etag)), "groups")
    new.write.mode("append").parquet(f"{out}/groups")
    now = files.load_table(spark, f"{out}/groups", f"{transfer.GROUP}, take_bytes BIGINT, etag STRING").where(F.col("error").isNull() & (F.col("etag") == etag))
    sums = now.join(plan.select("name", "take_bytes"), ["name", "take_bytes"], "left_semi").dropDuplicates(["name"]).agg(F.count(F.lit(1)).alias("n"), F.sum("images").alias("images"), F.sum("image_bytes").alias("bytes")).head()
    failed = [r.asDict() for r in new.where("error IS NOT NULL").select("name", "error").orderBy("name").limit(100).collect()]
    report = {"groups": sums["n"], "images": sums["images"] or 0, "image_bytes": sums["bytes"] or 0, "fetched": new.count(), "errors": failed}
    if not failed and expected is not None and report["images"] != expected:
        raise ValueError(f"{report['images']} images, {expected} expected")
    files.write_json(f"{out}/download.json", report)
    return report


def trial(spark: SparkSession, root: str, subset: DataFrame, s: config.Settings, make: Callable[[], Backbone], workers: int, batch: int, stage: str, repeat: int = 0) -> dict:
    """The whole job of `generate` without resume on a subset, in a folder of its own that is removed: one run of a report.

    `workers` is the number of tasks that decode, and of each shuffle. Memory that runs out in the backbone is the status oom; other errors are raised.
    """
    changed = {"spark.sql.shuffle.partitions": str(workers), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    fingerprint, total = s.fingerprint("none"), subset.count()
    run = {"stage": stage, "repeat": repeat, "cpu_workers": workers, "batch_size": batch}
    with scratch(spark, f"trial-{stage}") as folder:
        out, began = f"{folder}/out", time.perf_counter()
        try:
            for k, v in changed.items():
                spark.conf.set(k, v)
            failed = label_images(spark, root, subset, out, s, make, fingerprint, batch, workers).select("image").distinct().count()
        except PySparkException as e:
            if "out of memory" not in str(e).lower():
                raise
            return run | {"status": "oom", "images_processed": 0, "images_failed": total, "elapsed_seconds": time.perf_counter() - began, "throughput_images_per_sec": 0.0, "labelled": 0, "quality": None}
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        elapsed = time.perf_counter() - began
        labels, known = files.load_labels(spark, out)
        run |= {"labelled": receipts.valid(subset, known, labels, fingerprint, root).count(), "quality": quality_of(spark, out, subset, fingerprint, root)}
    done = total - failed
    return run | {"status": "ok" if not failed else "failed", "images_processed": done, "images_failed": failed, "elapsed_seconds": elapsed, "throughput_images_per_sec": done / elapsed}


def benchmark(spark: SparkSession, root: str, s: config.Settings, images: int | None = None, make: Callable[[], Backbone] = HashBackbone, workers: list[int] | None = None) -> dict:
    """Smoke trial, repeated trials of partitions by batch size, and a confirmation trial of the best stable candidate.

    A trial is the whole job (see `trial`); the forecast rests on the confirmation. Their subsets are prefixes of one
    order, of the sizes in the settings, and none is larger than `images`.
    """
    b = s.benchmark
    records = cut(catalog.require_rows(catalog.scan(spark, root), f"no images in {root}"), "records")
    most = max(b.smoke_images, b.scaling_images, b.confirmation_images)
    subset = cut(catalog.deterministic_subset(records, most if images is None else min(images, most), s.pipeline.seed), "subset")
    first = lambda n: subset.where(F.col("rank") <= n)
    run = lambda stage, n, *how: trial(spark, root, first(n), s, make, *how[:2], stage, *how[2:])
    smoke = run("smoke", b.smoke_images, 1, 1)
    if smoke["status"] != "ok" or smoke["labelled"] != smoke["images_processed"]:
        raise RuntimeError(f"smoke trial: {smoke['images_failed']} images failed, {smoke['labelled']} have a valid label")
    if not smoke["quality"]["total_boxes"]:
        raise RuntimeError("smoke trial: no boxes on any image")
    scaling, warnings = [], []
    counts = planner.worker_candidates(workers or list(b.worker_counts), spark.sparkContext.defaultParallelism)
    for batch, n in itertools.product(sorted(set(b.batch_sizes)), counts):
        if any(r["status"] == "oom" for r in scaling):
            warnings.append("out of memory: no further candidates")
            break
        for repeat in range(b.repeats):
            scaling.append(run("scaling", b.scaling_images, n, batch, repeat))
            if scaling[-1]["status"] != "ok":
                break
    table = spark.createDataFrame([(r["cpu_workers"], r["batch_size"], r["status"], r["throughput_images_per_sec"]) for r in scaling], "workers INT, batch INT, status STRING, throughput DOUBLE")
    candidates = planner.candidates(table, b.repeats)
    best = planner.choose_best(candidates, b.min_stability_ratio).collect()
    if not best:
        raise RuntimeError("no candidate is stable; measure more images")
    confirmation = run("confirmation", b.confirmation_images, best[0]["workers"], best[0]["batch"])
    if confirmation["status"] != "ok":
        raise RuntimeError(f"confirmation trial: {confirmation['images_failed']} images failed")
    rate = confirmation["throughput_images_per_sec"]
    forecast = spark.range(1).select(*planner.estimate(F.lit(rate), F.lit(records.count()))).collect()[0].asDict()
    confirmed = spark.range(1).select(planner.qualified(F.lit(confirmation["images_processed"]), F.lit(b.repeats)).alias("q")).collect()[0]["q"]
    return {"best": best[0].asDict(), "candidates": [r.asDict() for r in candidates.collect()], "runs": [smoke, *scaling, confirmation], "estimate": forecast, "qualified": confirmed, "warnings": warnings}


def match_images(features: DataFrame, supports: DataFrame, proposals: DataFrame, threshold: float = -1.0, min_margin: float = 0.0) -> DataFrame:
    """image, ord, top1, cosine, margin, label of proposed boxes. `supports`: image, cls (whole images)."""
    whole = supports.select("image", F.lit(0).alias("ord"), *[F.lit(v).alias(c) for c, v in (("x", 0.5), ("y", 0.5), ("w", 1.0), ("h", 1.0))])
    protos = fewshot.prototypes(roi.pool(features, whole).join(supports, "image").select("cls", "vec"))
    queries = roi.pool(features, proposals).select(F.struct("image", "ord").alias("id"), "vec")
    return fewshot.match(fewshot.ranked(queries, protos), threshold, min_margin).select("id.*", "top1", "cosine", "margin", "label")


def localisation(matched: DataFrame, pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: references, localized, correct, recalls and the mean of class recalls.

    `matched`: image, ord, label; `pairs`: image, p, r; `truth`: image, ord, cls.
    """
    paired = pairs.join(matched.select("image", F.col("ord").alias("p"), "label"), ["image", "p"]).select(F.struct("image", F.col("r").alias("ord")).alias("id"), "label")
    t = fewshot.tally(paired, truth.select(F.struct("image", "ord").alias("id"), "cls"))
    return t.agg(
        F.sum("total").alias("reference"), F.sum("found").alias("localized"), F.sum("correct").alias("correct"), F.try_divide(F.sum("found"), F.sum("total")).alias("proposal_recall"),
        F.try_divide(F.sum("correct"), F.sum("total")).alias("correct_recall"), F.avg("recall").alias("macro_recall"),
    )


def prepare_training(spark: SparkSession, root: str, out: str, s: config.Settings, target: str, routes: dict[str, str], model_digest: str = "none") -> DataFrame:
    """Links, labels and lists of images by split, once every image has a valid label. Returns the counts.

    An error names an image without a label or one that training would turn or repair, and a split without images or boxes.
    """
    records = cut(catalog.scan(spark, root), "records")
    labels, known = files.load_labels(spark, out)
    valid = cut(receipts.valid(records, known, labels, s.fingerprint(model_digest), root), "valid")
    receipts.require_complete(records, valid)
    routed = valid.withColumn("split", catalog.route(F.col("relative"), routes))
    boxes, images = stored_boxes(spark, out, records, s.fingerprint(model_digest), root)
    counts = quality.counts(images, boxes).join(routed.select(F.col("relative").alias("image"), "split"), "image")
    per_split = cut(quality.split_counts(counts), "splits")
    found = {r["split"]: r["boxes"] for r in per_split.collect()}
    for split in sorted(set(routes.values())):
        if not found.get(split):
            raise ValueError(f"no {'boxes' if split in found else 'images'} in {split}")
    jpegs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG}").load(root)
    if wrong := jpegs.where(~image_source.upright_jpeg(F.col("content"))).select("path").limit(1).collect():
        raise ValueError(f"torn or turned by a tag: {wrong[0]['path']}")
    text = labels.select(F.col("image").alias("relative"), "label", F.sha2(F.col("label").cast("binary"), 256).alias("label_sha256")).distinct()
    linked = cut(files.link_training(routed.join(text, ["relative", "label_sha256"]), target), "linked")
    if failed := linked.where("error IS NOT NULL").limit(1).collect():
        raise OSError(f"{failed[0]['image']}: {failed[0]['error']}")
    files.training_folder(routed.withColumn("path", F.concat(F.lit(f"{target}/images/"), "split", F.lit("/"), "relative")), target)
    return per_split


def predict(spark: SparkSession, root: str, out: str, detect: Callable[[DataFrame], DataFrame], least: float, limit: int = 0) -> int:
    """Detections of a seam (image, ord, class_id, label, confidence, box) at or above a confidence, an image a JSON row."""
    records = catalog.scan(spark, root).orderBy("path")
    chosen = cut(records.limit(limit) if limit else records, "inputs")
    found = fewshot.confident(detect(image_source.decoded(spark, root, chosen)), least)
    files.save_predictions(found, chosen.select(F.col("relative").alias("image")), out)
    return chosen.count()


def preview(spark: SparkSession, root: str, out: str, s: config.Settings, n: int, model_digest: str = "none") -> DataFrame:
    """What a preview would show, from stored labels alone."""
    records = catalog.scan(spark, root)
    boxes, images = stored_boxes(spark, out, records, s.fingerprint(model_digest), root)
    ranked = quality.counts(images, boxes).withColumn("rank", scalars.subset_rank(s.pipeline.seed, F.col("image")))
    return catalog.preview(ranked, "n_boxes", ["rank", "image"], n).select("image", "n_boxes")


def key_preview(spark: SparkSession, root: str, s: config.Settings, n: int, make: Callable[[], Backbone] = HashBackbone) -> DataFrame:
    """Colours of the patches of a deterministic subset."""
    subset = catalog.deterministic_subset(catalog.scan(spark, root), n, s.pipeline.seed)
    features, _ = features_of(spark, root, cut(subset, "subset"), s, make)
    return pca.rgb(features.where("error IS NULL"))
