"""Deeply nested records as related flat tables: one depth-first pass emits tagged rows, written by tag, read typed.

Each row has a tag, its own key (`pk`), its parent's key (`parent_pk`) and a JSON payload. Keys are paths of positions, so
a child names its parent whatever else arrives. Positions count from 0 and count nulls.

Defined results. A null, torn or non-object payload emits nothing; a payload encoded many times is decoded as often. Null or
differently shaped entries of a list emit nothing and never fail their siblings. Every other part without a column or a
row of its own (errors, quality, metadata, system and so on) is kept as JSON in the `rest` of its row. A single sample in place of a list has position 0.
Rows repeated under one `report_id` count once; of different payloads under one id the largest stands. Rows without an id
are told apart by their payload. Empty input gives empty tables. A number in quotes is read as the number,
other text in a numeric column as null; the coordinates of a box must be numbers without quotes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchloom.functions.arrow import emit_rows
from patchloom.session import shared_path

EMITTED = T.StructType(
    [
        T.StructField("tag", T.StringType()),
        T.StructField("report_id", T.LongType()),
        T.StructField("pk", T.StringType()),
        T.StructField("parent_pk", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("parent_ord", T.LongType()),
        T.StructField("child_ord", T.LongType()),
        T.StructField("payload", T.StringType()),
    ]
)
#: Schema of each tag's payload. `rest` is added: JSON of the parts that are in no column and no row of their own.
PAYLOADS = {
    "report": "schema_version STRING, run_id STRING, kind STRING, status STRING",
    "run": "stage STRING, repeat STRING, status STRING, images_processed BIGINT, decode_seconds DOUBLE, dino_seconds DOUBLE, maskcut_seconds DOUBLE, backpressure_seconds DOUBLE",
    "sample": "image STRING, seconds DOUBLE, grid ARRAY<INT>",
    "box": "x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, score DOUBLE",
    "mask": "mask_id BIGINT, area BIGINT, cells ARRAY<ARRAY<INT>>",
    "part": "part BIGINT, area BIGINT",
    "model": "",
}
PAYLOADS = {tag: f"{columns}, rest STRING".removeprefix(", ") for tag, columns in PAYLOADS.items()}
NAMES = {tag: {f.split()[0] for f in columns.split(", ")} - {"rest"} for tag, columns in PAYLOADS.items()}

NUMERIC = (T.DoubleType, T.LongType)


def _typed(value: Column, kind: T.DataType) -> Column:
    """A number is read as text first, as from_json has no value for one in quotes. A Java suffix, as of 1d, is no number."""
    return F.when(~value.rlike(r"[0-9.][dDfF]\s*$"), value.try_cast(kind)) if isinstance(kind, NUMERIC) else value


def decode(payload: str | None) -> dict | None:
    """The payload's object, decoded once more for each time it was encoded as a string."""
    while isinstance(payload, str):  # decoding a string takes its quotes away, so this ends
        try:
            payload = json.loads(payload.removeprefix("﻿"))
        except (ValueError, RecursionError):
            return None
    return payload if isinstance(payload, dict) else None


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and x == x


def box_of(entry) -> dict | None:
    """A box with all four numbers, given as an array of four or as an object."""
    if isinstance(entry, list) and len(entry) == 4:
        entry = dict(zip("xywh", entry))
    if not isinstance(entry, dict) or not all(_number(entry.get(k)) for k in "xywh"):
        return None
    return {k: entry[k] for k in "xywh"} | ({"score": entry["score"]} if _number(entry.get("score")) else {})


def _row(tag: str, node: dict, apart: dict | None = None) -> str:
    """The payload of a row: what has a column, and all else, with `apart`, as JSON text in `rest`. Parts with rows of their own are not in `node`."""
    wide = {"grid", "cells"}
    kept = {k: v for k, v in node.items() if k in NAMES[tag] and (isinstance(v, list) if k in wide and v is not None else not isinstance(v, (dict, list)))}
    rest = {k: v for k, v in node.items() if k not in kept} | (apart or {})
    return json.dumps(kept | ({"rest": json.dumps(rest)} if rest else {}), ensure_ascii=False)


def _without(node: dict, **children: type | tuple) -> dict:
    """`node` less the named parts that are of the type whose rows are emitted."""
    return {k: v for k, v in node.items() if k not in children or not isinstance(v, children[k])}


def _step(name: str) -> str:
    """A name as one step of a key, whatever it holds."""
    return name.replace("~", "~0").replace("/", "~1")


def visit(report_id: int | None, payload: str | None) -> Iterator[tuple]:
    """All rows of one report, parents first."""
    root = decode(payload)
    if root is None:
        return
    top = str(report_id) if report_id is not None else f"~{hashlib.md5(payload.encode()).hexdigest()}"
    models = root.get("models")
    models = models if isinstance(models, dict) else {}
    odd = {k: v for k, v in models.items() if not isinstance(v, dict)}
    yield "report", report_id, top, None, "", 0, 0, _row("report", _without(root, runs=list, samples=(list, dict), models=dict), {"models": odd} if odd else None)
    runs = root.get("runs")
    for i, run in enumerate(runs if isinstance(runs, list) else []):
        if isinstance(run, dict):
            timing = run.get("timing_seconds")
            timing = timing if isinstance(timing, dict) else {}
            timed = {k: v if not isinstance(v, (dict, list)) else json.dumps(v) for k, v in timing.items() if k in NAMES["run"]}
            own = {k: v for k, v in _without(run, timing_seconds=dict).items() if k != "dino_seconds" and k not in timed}
            # a time of the run itself, beside those of timing_seconds, is no column
            apart = {k: v for k, v in run.items() if k == "dino_seconds" or k in timed}
            left = {k: v for k, v in timing.items() if k not in timed}
            yield "run", report_id, f"{top}/runs/{i}", top, "", i, 0, _row("run", own | timed, apart | ({"timing_seconds": left} if left else {}))
    for m, model in models.items():
        if isinstance(model, dict):
            yield "model", report_id, f"{top}/models/{_step(m)}", top, m, 0, 0, _row("model", _without(model, samples=(list, dict)))
    places = [(top, "", root.get("samples"))] + [(f"{top}/models/{_step(m)}", m, x.get("samples")) for m, x in models.items() if isinstance(x, dict)]
    for owner, model, samples in places:
        for i, sample in enumerate(samples if isinstance(samples, list) else [samples]):
            if not isinstance(sample, dict):
                continue
            pk = f"{owner}/samples/{i}"
            yield "sample", report_id, pk, owner, model, i, 0, _row("sample", _without(sample, boxes_xywh_normalized=list, masks=list))
            boxes, masks = sample.get("boxes_xywh_normalized"), sample.get("masks")
            for j, entry in enumerate(boxes if isinstance(boxes, list) else []):
                if box := box_of(entry):
                    extra = {k: v for k, v in entry.items() if k not in box} if isinstance(entry, dict) else {}
                    yield "box", report_id, f"{pk}/boxes/{j}", pk, model, i, j, _row("box", box, extra)
            for j, mask in enumerate(masks if isinstance(masks, list) else []):
                if not isinstance(mask, dict):
                    continue
                yield "mask", report_id, f"{pk}/masks/{j}", pk, model, i, j, _row("mask", _without(mask, children=list))
                parts = mask.get("children")
                for k, part in enumerate(parts if isinstance(parts, list) else []):
                    if isinstance(part, dict):
                        yield "part", report_id, f"{pk}/masks/{j}/children/{k}", f"{pk}/masks/{j}", model, j, k, _row("part", part)


class FlatTables:
    """The flat tables of a set of reports, in the shared folder, partitioned by tag."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, reports: DataFrame, path: str | None = None) -> FlatTables:
        """`reports`: report_id, payload; other columns are ignored. One pass over each payload."""
        spark = reports.sparkSession
        path = path or shared_path(spark, "flat")
        nameless = F.when(F.col("report_id").isNull(), F.md5(F.col("payload").cast("binary")))
        once = reports.groupBy("report_id", nameless.alias("_nameless")).agg(F.max("payload").alias("payload"))
        emit_rows(once.select("report_id", "payload"), visit, EMITTED).write.partitionBy("tag").parquet(path)
        return cls(spark, path)

    def emitted(self) -> DataFrame:
        return self.spark.read.schema(EMITTED).parquet(self.path)

    def read(self, tag: str) -> DataFrame:
        """One flat table with its payload typed. Only this tag's files are read."""
        rows = self.emitted().where(F.col("tag") == tag).drop("tag")
        wanted = T.StructType.fromDDL(PAYLOADS[tag])
        as_text = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, NUMERIC) else f.dataType) for f in wanted])
        parsed = rows.withColumn("_p", F.from_json("payload", as_text))
        return parsed.select(*rows.columns[:-1], *[_typed(F.col("_p")[f.name], f.dataType).alias(f.name) for f in wanted])

    def children(self) -> DataFrame:
        """Runs with dino seconds, boxes and masks as (report_id, child, model, parent_ord, child_ord)."""
        rows = self.emitted().where(F.col("tag").isin("run", "box", "mask"))
        timed = (F.col("tag") != "run") | F.get_json_object("payload", "$.dino_seconds").isNotNull()
        return rows.where(timed).select("report_id", F.col("tag").alias("child"), "model", "parent_ord", "child_ord")
