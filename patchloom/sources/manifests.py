"""Manifests and annotations: JSON manifests, VOC XML, metric CSVs, selection lists."""

from __future__ import annotations

from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from patchloom.functions.geometry import from_corners
from patchloom.session import ship

MANIFEST = "images ARRAY<STRUCT<id: STRING, `class`: STRING, role: STRING, file: STRING, sha256: STRING, url: STRING>>"


def manifest_images(spark: SparkSession, path: str) -> DataFrame:
    """ord and fields of each image of a JSON manifest (one object a file), in its order."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.posexplode("images").alias("ord", "i")).select("ord", "i.*")


def by_role(images: DataFrame, role: str) -> DataFrame:
    return images.where(F.col("role") == role)


def selection(spark: SparkSession, path: str) -> DataFrame:
    """ord, relative of a selection list, one path a line, in its order."""
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    return spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("ord", "relative"))


#: The corners of a box in an annotation (VOC).
CORNERS = ("xmin", "ymin", "xmax", "ymax")


def _plain_voc() -> str:
    """Pattern of annotations of the elements that are read and no others, in this order, without attributes, references or control characters."""
    gap = r"[ \t\r\n]*"
    leaf = lambda name: f"<{name}>[^<>&[:cntrl:]]*</{name}>{gap}"
    within = lambda name, body: f"<{name}>{gap}{body}</{name}>{gap}"
    one = within("object", leaf("name") + within("bndbox", "".join(leaf(k) for k in CORNERS)))
    return r"\A" + gap + within("annotation", within("size", leaf("width") + leaf("height")) + f"(?:{one})*") + r"\z"


def _number(text: str | None) -> float | None:
    try:
        return float(text) if text and "_" not in text else None
    except ValueError:
        return None


def _numbers(texts: pa.Array) -> pa.Array:
    """As doubles; null where a text is no number."""
    try:
        return texts.cast(pa.float64())
    except pa.ArrowInvalid:
        return pa.array([_number(t) for t in texts.to_pylist()], pa.float64())


def _split_voc(xml: pa.Array) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Of plain annotations: row and ord of each object, and its texts (size, name, corners). Tags lie at known places, so whole columns are split at them."""
    first, each, end = 8, 14, 9  # pieces before the objects, of an object, and of an annotation without objects
    lists = pc.split_pattern(xml, "<")
    pieces, offsets = lists.values, lists.offsets.to_numpy()
    n = (np.diff(offsets) - end) // each
    row = np.repeat(np.arange(len(n)), n)
    ord_ = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    head = offsets[row]
    start = head + first + ord_ * each
    places = [(head + 3, "width"), (head + 5, "height"), (start + 1, "name"), *[(start + 4 + 2 * k, c) for k, c in enumerate(CORNERS)]]
    return row, ord_, [pc.utf8_slice_codeunits(pieces.take(pa.array(at)), len(name) + 1) for at, name in places]


def _tree_voc(xml: pa.Array) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """As `_split_voc`, of any annotation, by the XML parser; one that is not well-formed is an error."""
    rows = []
    for i, text in enumerate(xml.to_pylist()):
        root = ElementTree.fromstring(text)
        if root.tag == "annotation":
            size = [root.findtext("size/width"), root.findtext("size/height")]
            rows += [(i, k, *size, o.findtext("name"), *[o.findtext(f"bndbox/{c}") for c in CORNERS]) for k, o in enumerate(root.findall("object"))]
    row, ord_, *texts = zip(*rows) if rows else [()] * (5 + len(CORNERS))
    return np.array(row, np.int64), np.array(ord_, np.int64), [pa.array(t, pa.string()) for t in texts]


def parse_voc(files: DataFrame, names: dict[str, str], tolerance: float = 0.01) -> DataFrame:
    """id, ord, label, x, y, w, h of the annotated objects. `files`: id, xml, width, height (of the image itself).

    Names not in `names` are passed over. Pixels are one-based and inclusive, boxes half open and normalized. A box without
    area or a corner, or an annotation without size or of another aspect than its image, is an error. Each annotation is read
    once: plain ones by whole Arrow columns, the others by the XML parser.
    """
    ship(files.sparkSession)
    files = files.select("id", "xml", F.col("width").cast("double"), F.col("height").cast("double"))
    fields = [T.StructField("ord", T.IntegerType()), T.StructField("label", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("aw", "ah", *CORNERS)]]
    schema = T.StructType([files.schema["id"], *fields])
    arrow, pattern = to_arrow_schema(schema), _plain_voc()
    known, labels = pa.array(names, pa.string()), pa.array(names.values(), pa.string())

    def found(batch: pa.RecordBatch, read) -> pa.RecordBatch:
        row, ord_, (aw, ah, name, *corners) = read(batch["xml"])
        aw, ah = _numbers(aw), _numbers(ah)
        image = [batch[c].take(pa.array(row)) for c in ("width", "height")]
        with np.errstate(all="ignore"):
            a, b, c, d = (v.to_numpy(zero_copy_only=False) for v in (aw, ah, *image))
            off = ~(np.abs(a / b - c / d) <= tolerance) & ~np.array(pc.or_(*[v.is_null() for v in image]))
        if off.any():
            raise ValueError("annotation and image disagree in aspect")
        at = pc.index_in(name, known)
        kept = at.is_valid()
        cols = [batch["id"].take(pa.array(row)), pa.array(ord_, pa.int32()), labels.take(at), aw, ah, *[_numbers(c) for c in corners]]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow).filter(kept)

    def run(batches):
        for batch in batches:
            plain = pc.match_substring_regex(batch["xml"], pattern)  # null, as the text is, keeps out of both
            for rows, read in ((plain, _split_voc), (pc.invert(plain), _tree_voc)):
                part = batch.filter(rows)
                if part.num_rows:
                    yield found(part, read)

    read = files.mapInArrow(run, schema)
    x0, y0 = F.greatest(F.lit(0.0), F.col("xmin") - 1), F.greatest(F.lit(0.0), F.col("ymin") - 1)
    x1, y1 = F.least("aw", "xmax"), F.least("ah", "ymax")
    missing = F.col("xmin").isNull() | F.col("ymin").isNull() | F.col("xmax").isNull() | F.col("ymax").isNull()
    x1 = F.when(missing | (x1 <= x0) | (y1 <= y0), F.raise_error(F.lit("annotated box has no area")).cast("double")).otherwise(x1)
    return read.select("id", "ord", "label", from_corners(x0, y0, x1, y1, F.col("aw"), F.col("ah")).alias("b")).select("id", "ord", "label", "b.*")


def last_metrics(spark: SparkSession, path: str, order: str = "epoch") -> dict[str, str]:
    """The row of the largest epoch of a metrics CSV, names without blanks around; nothing where there is no file."""
    from patchloom.session import filesystem

    fs, jpath = filesystem(spark, path)
    if not fs.exists(jpath):
        return {}
    df = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    df = df.toDF(*[c.strip() for c in df.columns])
    rows = df.orderBy(F.desc(F.col(order).try_cast("double"))).limit(1).collect()
    return rows[0].asDict() if rows else {}
