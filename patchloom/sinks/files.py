"""Sinks: atomic files, locks, labels with receipts, reports, training folders, predictions."""

from __future__ import annotations

import contextlib
import csv
import io
import json
import os
import socket
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.session import filesystem


def _folder(path: str | Path):
    """Of a path on any file system Hadoop knows: the file system, the path's own object, and its folder's."""
    fs, place = filesystem(SparkSession.active(), str(path))
    return fs, place, place.getParent()


def atomic_write(path: str | Path, data: bytes, durable: bool = True) -> None:
    """All or nothing: a reader sees the old file or the new one. The new one is written beside it and renamed over it."""
    fs, place, folder = _folder(path)
    jvm = SparkSession.active().sparkContext._jvm
    beside = jvm.org.apache.hadoop.fs.Path(folder, f"_{place.getName()}.{uuid.uuid4().hex}")
    fs.mkdirs(folder)
    try:
        out = fs.create(beside, False)
        out.write(bytearray(data))
        if durable:
            out.hsync()
        out.close()
        _rename_over(jvm, fs, beside, place)
    finally:
        fs.delete(beside, False)


def _rename_over(jvm, fs, source, target) -> None:
    how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = SparkSession.active().sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(fs.makeQualified(source), fs.makeQualified(target), options)


def write_json(path: str | Path, value, durable: bool = True) -> None:
    """NaN and infinities are refused: they are no JSON."""
    atomic_write(path, (json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n").encode(), durable)


@contextlib.contextmanager
def exclusive(path: str | Path):
    """The one holder of a name, on any shared file system: who creates the file holds it, and removes it in the end.

    A second one gets an error instead of waiting. The file tells host and process; one of this host whose process has
    ended is taken over, another's must be removed by hand.
    """
    fs, place, folder = _folder(path)
    fs.mkdirs(folder)
    for attempt in (1, 2):
        try:
            out = fs.create(place, False)
            break
        except Exception as e:
            if attempt == 2 or not _is_left_behind(fs, place):
                raise RuntimeError(f"{path} is in use") from e
            fs.delete(place, False)
    out.write(bytearray(f"{socket.gethostname()} {os.getpid()}".encode()))
    out.close()
    try:
        yield
    finally:
        fs.delete(place, False)


def _is_left_behind(fs, place) -> bool:
    """The holder was a process of this host that has ended."""
    stream = fs.open(place)
    host, _, pid = bytes(stream.readAllBytes()).decode().partition(" ")
    stream.close()
    return host == socket.gethostname() and pid.isdigit() and not os.path.exists(f"/proc/{pid}")


def save_labels(labelled: DataFrame, receipt: DataFrame, root: str) -> None:
    """Labels (image, label) first, receipts after them: what has no receipt is not done. Both are appended."""
    labelled.select("image", "label").write.mode("append").parquet(f"{root}/labels")
    receipt.write.mode("append").json(f"{root}/receipts")


RECEIPT = "schema INT, fingerprint STRING, dataset_root STRING, image STRING, source_size BIGINT, source_mtime_ns BIGINT, image_size ARRAY<INT>, label_sha256 STRING, boxes INT"


def load_table(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A table written so far; an empty one before the first."""
    fs, place = filesystem(spark, path)
    return spark.read.schema(schema).format(kind).load(path) if fs.exists(place) else spark.createDataFrame([], schema)


def load_labels(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(labels, receipts) written so far."""
    return load_table(spark, f"{root}/labels", "image STRING, label STRING"), load_table(spark, f"{root}/receipts", RECEIPT, "json")


REPORT_COLUMNS = [
    "stage", "repeat", "status", "cpu_workers", "batch_size", "images_processed", "images_failed", "images_skipped", "elapsed_seconds",
    "throughput_images_per_sec", "dino_ms_image", "maskcut_ms_image", "io_ms_image", "bbox_ms_image", "backpressure_seconds", "gpu_peak_vram_bytes",
]


def report_rows(payload: dict) -> list[dict]:
    """A row a run: stage times an image, where reading and writing together are io."""
    rows = []
    for run in payload.get("runs") or []:
        ms, seconds = run.get("timing_ms_per_image") or {}, run.get("timing_seconds") or {}
        derived = {"dino_ms_image": ms.get("dino"), "maskcut_ms_image": ms.get("maskcut"), "bbox_ms_image": ms.get("bbox"), "backpressure_seconds": seconds.get("backpressure_seconds")}
        if "decode" in ms or "write" in ms:
            derived["io_ms_image"] = (ms.get("decode") or 0) + (ms.get("write") or 0)
        rows.append({c: run.get(c, derived.get(c)) for c in REPORT_COLUMNS})
    return rows


def save_report(folder: str | Path, payload: dict) -> None:
    """report.json, runs.csv and summary.md of one run."""
    rows = report_rows(payload)
    text = io.StringIO()
    writer = csv.DictWriter(text, REPORT_COLUMNS)
    writer.writeheader()
    writer.writerows(rows)
    shown = ["stage", "repeat", "status", "images_processed", "throughput_images_per_sec"]
    lines = [f"# {payload.get('kind')} {payload.get('run_id')}", "", f"Status: {payload.get('status')}", "", "| " + " | ".join(shown) + " |", "|" + "---|" * len(shown)]
    lines += ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in shown) + " |" for r in rows]
    lines += ["", *[f"- {w}" for w in payload.get("warnings") or []]]
    write_json(f"{folder}/report.json", payload)
    atomic_write(f"{folder}/runs.csv", text.getvalue().encode())
    atomic_write(f"{folder}/summary.md", "\n".join(lines).encode())


TIMINGS = ["model", "image", "decode_ms", "forward_ms", "keys_cut_box_write_ms", "tokens_cut_box_write_ms", "key_boxes", "token_boxes"]


def save_timings(timings: DataFrame, out: str) -> None:
    """The timings of backbones as CSV with a header, a row a model and image."""
    timings.select(*TIMINGS).write.mode("overwrite").csv(out, header=True)


def training_folder(routed: DataFrame, out: str) -> None:
    """Lists of images by split (`split`, `path`) as text partitions, and the data file that names them."""
    routed.select("split", F.col("path").alias("value")).write.mode("overwrite").partitionBy("split").text(f"{out}/lists")
    splits = sorted(r["split"] for r in routed.select("split").distinct().collect())  # a name a folder
    lines = [f"path: {out}", *[f"{s}: lists/split={s}" for s in splits], "names:", "  0: object"]
    atomic_write(f"{out}/data.yaml", ("\n".join(lines) + "\n").encode())


LINKED = "split STRING, image STRING, error STRING"


def link_training(rows: DataFrame, out: str) -> DataFrame:
    """Put each image's link at images/split/relative and its label at labels/split/key below `out`; a row each, with an error if it failed.

    `rows`: split, relative, key, path, label. `out` is on a file system all executors mount. What is there is replaced as a
    whole, so a run that broke off is done again without harm.
    """
    columns = [c.split()[0] for c in LINKED.split(", ")]

    def replace(target: Path, make) -> None:
        target.parent.mkdir(parents=True, exist_ok=True)
        beside = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
        make(beside)
        os.replace(beside, target)

    def run(batches):
        for batch in batches:
            told = []
            for r in batch.itertuples():
                try:
                    replace(Path(out, "images", r.split, r.relative), lambda p: p.symlink_to(r.path))
                    replace(Path(out, "labels", r.split, r.key), lambda p: p.write_text(r.label))
                    told.append((r.split, r.relative, None))
                except OSError as e:
                    told.append((r.split, r.relative, str(e)[:1000]))
            yield pd.DataFrame(told, columns=columns)

    return rows.select("split", "relative", "key", "path", "label").mapInPandas(run, LINKED)


def fetch_once(path: str, digest: str, fetch) -> bool:
    """`images.fetch_verified` by one process at a time. Tells whether it was fetched."""
    from patchloom.sources.images import fetch_verified

    with exclusive(f"{path}.lock"):
        return fetch_verified(path, digest, fetch, atomic_write)


def save_predictions(found: DataFrame, images: DataFrame, out: str) -> None:
    """One JSON row an image with its boxes in order, images without any too. `found`: image, ord, label, confidence, box."""
    boxes = found.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("ord", "label", "confidence", "box"))).alias("boxes"))
    rows = images.select("image").join(boxes, "image", "left")
    rows.withColumn("n_boxes", F.coalesce(F.size("boxes"), F.lit(0))).write.mode("overwrite").json(out)
