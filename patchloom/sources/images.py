"""Images as tables, and the seam for models: decoding in the JVM, features by any object that keeps the contract."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from patchloom.session import filesystem

#: Mean and deviation of red, green and blue that backbones expect.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


#: Images that one read is given by name, and up to how many are named at all.
NAMED, MOST_NAMED = 5_000, 200_000


def decoded(spark: SparkSession, root: str, records: DataFrame, named: int = NAMED, most_named: int = MOST_NAMED) -> DataFrame:
    """relative, width, height, channels, data (bytes in the order blue, green, red) of each record, or an error where it cannot be read.

    Only the records' own files are opened: they are named to the reader, some thousands a read, and their names go along
    with the pixels, which are not shuffled. Beyond `most_named` records, when the names alone are a load for the driver,
    the whole root is read and joined; the result is the same. A file that is gone is an error of its image.
    """
    want = records.select("path", "relative")
    few = want.limit(most_named + 1).collect()
    if len(few) > most_named:
        return _pixels(spark, [root], want.withColumn("known", F.lit(True)))
    out = None
    for start in range(0, max(1, len(few)), named):
        some = few[start : start + named]
        paths = [r["path"] for r in some]
        there = _existing(spark, paths)
        block = spark.createDataFrame([(r["path"], r["relative"], r["path"] in there) for r in some], "path STRING, relative STRING, known BOOLEAN")
        part = _pixels(spark, sorted(there), F.broadcast(block))  # at most `named` rows
        out = part if out is None else out.unionByName(part)
    return out


PIXELS = "path STRING, width INT, height INT, channels INT, data BINARY"


def _existing(spark: SparkSession, paths: list[str]) -> set[str]:
    """Those of the paths that are there; a folder is listed once."""
    found: set[str] = set()
    for folder in {p.rpartition("/")[0] for p in paths}:
        fs, place = filesystem(spark, folder or "/")
        if fs.exists(place):
            found.update(_plain(str(x.getPath())) for x in fs.listStatus(place))
    return found & set(paths)


def _plain(path: str) -> str:
    return re.sub("^file:/*", "/", path)


def _pixels(spark: SparkSession, sources: list[str], want: DataFrame) -> DataFrame:
    """The wanted records (path, relative, known) with what the image reader gives of `sources`."""
    raw = spark.createDataFrame([], PIXELS)
    if sources:
        escaped = [re.sub(r"([\\{}\[\]*?^,])", r"\\\1", x) for x in sources]
        found = spark.read.format("image").option("recursiveFileLookup", "true").load(escaped)
        at = lambda c: F.col(f"image.{c}")
        origin = F.url_decode(F.replace(at("origin"), F.lit("+"), F.lit("%2B")))  # it is told encoded, unlike paths
        raw = found.select(F.regexp_replace(origin, "^file:/*", "/").alias("path"), at("width").alias("width"), at("height").alias("height"), at("nChannels").alias("channels"), at("data").alias("data"))
    whole = want.join(raw.where("width > 0"), "path", "left")
    error = F.when(~F.col("known"), "is gone").when(F.col("data").isNull(), "cannot be decoded")
    return whole.select("path", "relative", "width", "height", "channels", "data", error.alias("error"))


def tensor(data: bytes, width: int, height: int, channels: int, side: int) -> np.ndarray:
    """A float32 array [3, side, side]: red first, resized as by an image library, normalized.

    A windowed sinc of three lobes, widened for shrinking, first along rows and then along columns, each time rounded to bytes.
    """
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    rgb = np.repeat(pixels[:, :, :1], 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]
    planes = rgb.transpose(2, 0, 1).astype(np.float64)
    planes = _bytes(planes @ _weights(width, side).T)
    planes = _bytes(_weights(height, side) @ planes)
    return ((planes / 255 - np.reshape(MEAN, (3, 1, 1))) / np.reshape(DEVIATION, (3, 1, 1))).astype(np.float32)


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255)


@functools.lru_cache(256)
def _weights(size: int, side: int, lobes: int = 3) -> np.ndarray:
    """A row a new pixel: the weights of the old ones, by distance from its centre in units of the wider of both pixels; each sums to 1."""
    wide = max(size / side, 1.0)
    centre = (np.arange(side) + 0.5) * size / side
    distance = (np.arange(size) + 0.5 - centre[:, None]) / wide
    w = np.where(np.abs(distance) < lobes, np.sinc(distance) * np.sinc(distance / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


class Backbone(Protocol):
    """A model. It may also have `warmup(batch, side)`, called once before it is used, and `extract_precise`, which is asked
    again, in full precision, for images whose features are not finite."""

    grid: tuple[int, int]

    def extract(self, batch: np.ndarray) -> np.ndarray:
        """float32 [batch, 3, side, side] to [batch, patches, channels]."""


class DualBackbone(Protocol):
    """A model that gives two kinds of features of one forward pass."""

    grid: tuple[int, int]

    def extract_both(self, batch: np.ndarray) -> dict[str, np.ndarray]:
        """float32 [batch, 3, side, side] to `keys` and `tokens`, each [batch, patches, channels]."""


class HashBackbone:
    """A stand-in that needs no weights: mean colour and spread of each patch. Deterministic; no claim of accuracy."""

    def __init__(self, grid: tuple[int, int] = (8, 8)):
        self.grid = grid

    def extract(self, batch: np.ndarray) -> np.ndarray:
        rows, cols = self.grid
        n, c, h, w = batch.shape
        cells = batch[:, :, : h // rows * rows, : w // cols * cols].reshape(n, c, rows, h // rows, cols, w // cols)
        mean, spread = cells.mean(axis=(3, 5)), cells.std(axis=(3, 5))
        return np.concatenate([mean, spread], axis=1).reshape(n, 2 * c, rows * cols).transpose(0, 2, 1).astype(np.float32)


class HashDual(HashBackbone):
    """The stand-in for two kinds of features: tokens are the keys with neighbouring channels mixed."""

    def extract_both(self, batch: np.ndarray) -> dict[str, np.ndarray]:
        keys = self.extract(batch)
        return {"keys": keys, "tokens": (keys + np.roll(keys, 1, axis=2)) / 2}


def started(make: Callable, batch: int, side: int):
    """The model of a worker, warmed up if it can be."""
    model = make()
    if hasattr(model, "warmup"):
        model.warmup(batch, side)
    return model


def extracted(model, tensors: np.ndarray) -> np.ndarray:
    """Features of a batch; images whose features are not finite are done again in full precision, if the model can."""
    found = model.extract(tensors)
    if hasattr(model, "extract_precise"):
        bad = ~np.isfinite(found).all(axis=tuple(range(1, found.ndim)))
        if bad.any():
            found = found.copy()
            found[bad] = model.extract_precise(tensors[bad])
    return found


def features(images: DataFrame, make: Callable[[], Backbone], side: int, batch: int = 16) -> DataFrame:
    """image, rows, cols, r, c, vec, error: a row a patch. `images`: as of `decoded`.

    The backbone is made once a worker. A wrong shape or a value not finite is an error row of its image.
    """
    schema = "image STRING, rows INT, cols INT, r INT, c INT, vec ARRAY<DOUBLE>, error STRING"

    def run(batches):
        model = started(make, batch, side)
        rows, cols = model.grid
        for frame in batches:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                good = part[part["error"].isna()]
                out = [(i, None, None, None, None, None, e) for i, e in zip(part["relative"], part["error"]) if e is not None]
                if len(good):
                    tensors = np.stack([tensor(d, w, h, c, side) for d, w, h, c in zip(good["data"], good["width"].astype(int), good["height"].astype(int), good["channels"].astype(int))])
                    found = extracted(model, tensors)
                    for image, patches in zip(good["relative"], found):
                        if patches.shape[0] != rows * cols or not np.isfinite(patches).all():
                            out.append((image, None, None, None, None, None, "features of another shape, or not finite"))
                        else:
                            out += [(image, rows, cols, i // cols, i % cols, v.tolist(), None) for i, v in enumerate(patches.astype(np.float64))]
                frame_out = pd.DataFrame(out, columns=["image", "rows", "cols", "r", "c", "vec", "error"])
                yield frame_out.astype({k: "Int32" for k in ("rows", "cols", "r", "c")})

    return images.select("relative", "width", "height", "channels", "data", "error").mapInPandas(run, schema)


def verified(content: Column, digest: Column) -> Column:
    return F.sha2(content, 256) == F.lower(digest)


def fetch_verified(path: str, digest: str, fetch: Callable[[], bytes], write: Callable[[str, bytes], None]) -> bool:
    """Reuse a file of the right digest, else fetch, verify and write it. Tells whether it was fetched."""
    try:
        with open(path, "rb") as f:
            if hashlib.file_digest(f, "sha256").hexdigest() == digest:
                return False
    except FileNotFoundError:
        pass
    data = fetch()
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError("what was fetched has another digest")
    write(path, data)
    return True


def exif_orientation(data: bytes) -> int | None:
    """The orientation tag of a JPEG's EXIF block, if there is one."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        block = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and block.startswith(b"Exif\0\0"):
            tiff = block[6:]
            order = "little" if tiff[:2] == b"II" else "big"
            start = int.from_bytes(tiff[4:8], order)
            for k in range(int.from_bytes(tiff[start : start + 2], order)):
                entry = tiff[start + 2 + 12 * k : start + 14 + 12 * k]
                if int.from_bytes(entry[:2], order) == 0x0112:
                    return int.from_bytes(entry[8:10], order)
        at += 2 + size
    return None


@F.pandas_udf(BooleanType())
def upright_jpeg(content: pd.Series) -> pd.Series:
    """Whole (it ends in the end marker) and not rotated by a tag."""
    return content.map(lambda b: bool(b) and bytes(b).endswith(b"\xff\xd9") and exif_orientation(bytes(b)) in (None, 1))
