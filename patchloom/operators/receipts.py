"""Labels and receipts: a receipt is the commit point, and resuming is an anti join against valid receipts."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from patchloom.functions.geometry import EDGE


@F.arrow_udf(StringType())
def _label_lines(boxes: pa.Array) -> pa.Array:
    """Eight decimals, exact ties to even: hashes of labels depend on it."""
    flat, offsets = boxes.values, boxes.offsets.to_pylist()
    lines = [f"0 {x:.8f} {y:.8f} {w:.8f} {h:.8f}\n" for x, y, w, h in zip(*[flat.field(k).to_pylist() for k in "xywh"])]
    return pa.array(["".join(lines[a:b]) for a, b in zip(offsets, offsets[1:])], pa.string())


def encode_labels(boxes: Column) -> Column:
    """The label file of an array of boxes in order; an empty one of no boxes."""
    return _label_lines(boxes)


_BOXES = ArrayType(StructType([StructField(k, DoubleType()) for k in "xywh"]))


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _numbers(words: pa.Array) -> np.ndarray:
    """Decimal numbers of words; NaN for other words."""
    plain = pc.if_else(pc.match_substring_regex(words, _NUMBER), words, pa.scalar(None, words.type))
    return pc.cast(plain, pa.float64()).to_numpy(zero_copy_only=False)


@F.arrow_udf(_BOXES)
def _label_boxes(texts: pa.Array) -> pa.Array:
    """All texts at once: lines, their words, numbers, checks of whole columns; a text is a box list if all its lines are boxes."""
    body = pc.if_else(pc.ends_with(texts, "\n"), pc.utf8_slice_codeunits(texts, 0, -1), texts)
    body = pc.if_else(pc.equal(texts, ""), pa.scalar(None, texts.type), body)  # no line at all, unlike an empty one
    lines = pc.split_pattern(body, "\n")
    text_of = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False)
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(lines.flatten()))
    five = pc.equal(pc.list_value_length(words), 5)
    told = words.filter(five).flatten()
    at = np.arange(len(told)).reshape(-1, 5)
    x, y, w, h = (_numbers(told.take(pa.array(at[:, k]))) for k in range(1, 5))
    with np.errstate(invalid="ignore"):
        reach = np.minimum(np.minimum(x - w / 2, y - h / 2), 1 - np.maximum(x + w / 2, y + h / 2))
        share = (np.minimum(x, y) >= 0) & (np.maximum(x, y) <= 1) & (np.minimum(w, h) > 0) & (np.maximum(w, h) <= 1)
        is_box = share & (reach >= -EDGE) & pc.equal(told.take(pa.array(at[:, 0])), "0").to_numpy(zero_copy_only=False)
    line_ok = five.to_numpy(zero_copy_only=False).astype(bool)
    where_ok = np.flatnonzero(line_ok)
    line_ok[where_ok] = is_box
    wrong = np.bincount(text_of[~line_ok], minlength=len(texts)) > 0
    kept = ~wrong[text_of[where_ok]]
    n = np.bincount(text_of[where_ok][kept], minlength=len(texts))
    structs = pa.StructArray.from_arrays([pa.array(v[kept]) for v in (x, y, w, h)], list("xywh"))
    missing = pa.array(wrong | texts.is_null().to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), structs, mask=missing)


def decode_labels(text: Column) -> Column:
    """The boxes of a label file as an array, or null if any of its rows is not `0 x y w h` of a box within the image.

    Whole Arrow columns at a time.
    """
    return _label_boxes(text)


def receipts(records: DataFrame, fingerprint: str, dataset_root: str) -> DataFrame:
    """Receipts of `records` (relative, size, mtime_ns, width, height, label as of `encode_labels`: a line a box)."""
    return records.select(
        F.lit(1).alias("schema"),
        F.lit(fingerprint).alias("fingerprint"),
        F.lit(dataset_root).alias("dataset_root"),
        F.col("relative").alias("image"),
        F.col("size").alias("source_size"),
        F.col("mtime_ns").alias("source_mtime_ns"),
        F.array("width", "height").alias("image_size"),
        F.sha2(F.col("label").cast("binary"), 256).alias("label_sha256"),
        F.regexp_count("label", F.lit("\n")).alias("boxes"),
    )


def valid(records: DataFrame, receipt: DataFrame, labels: DataFrame, fingerprint: str, dataset_root: str) -> DataFrame:
    """Records whose receipt and label agree with them in all fields, with label_sha256 and image_size of that receipt.

    `labels`: image, label. Where several receipts agree, the one of the largest digest counts.
    """
    r = receipt.where((F.col("schema") == 1) & (F.col("fingerprint") == fingerprint) & (F.col("dataset_root") == dataset_root))
    sized = (F.size("image_size") == 2) & F.forall("image_size", lambda x: x.isNotNull() & (x > 0))
    # hash and number are columns of the label side, so that they are computed where labels lie and texts are not shuffled
    facts = labels.select("image", F.sha2(F.col("label").cast("binary"), 256).alias("label_sha256"), F.size(decode_labels(F.col("label"))).alias("boxes"))
    done = r.where(sized).join(facts, ["image", "label_sha256", "boxes"])
    same = [F.col("image").alias("relative"), F.col("source_size").alias("size"), F.col("source_mtime_ns").alias("mtime_ns")]
    one = done.groupBy(*same).agg(F.max(F.struct("label_sha256", "image_size")).alias("_r"))
    return records.drop("label_sha256", "image_size").join(one, ["relative", "size", "mtime_ns"]).select(*[c for c in records.columns if c not in ("label_sha256", "image_size")], "_r.*")


def todo(records: DataFrame, done: DataFrame) -> DataFrame:
    """What is left to do: before anything expensive is planned on top of it."""
    return records.join(done.select("relative"), "relative", "left_anti")


def require_complete(records: DataFrame, done: DataFrame) -> DataFrame:
    missing = todo(records, done).limit(1).collect()
    if missing:
        raise ValueError(f"no valid label for {missing[0]['relative']}")
    return records


def label_digest(boxes: list[tuple[float, float, float, float]]) -> str:
    """What the receipt of these boxes must state; the driver-side twin of encode_labels and sha2."""
    if not all(math.isfinite(v) for b in boxes for v in b):
        raise ValueError("a box is not finite")
    return hashlib.sha256("".join("0 " + " ".join(f"{v:.8f}" for v in b) + "\n" for b in boxes).encode()).hexdigest()
