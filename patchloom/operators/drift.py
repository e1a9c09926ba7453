"""Schemas that drift between files: header schemas, a promotion lattice, one consistent table, a log of changes.

Defined results. A null body, a torn file, JSON whose top value is not an object, or JSON nested deeper than the parser
allows is skipped. A null value tells nothing: it neither adds nor removes its field. An empty object holds no field. Rows
repeated under one `file_id` count once; files without an id count by their fields, and their changes have a null id. Files
of a null workspace are one workspace. NaN and infinities are no JSON. Empty input gives empty results. Two vanished and one appeared field of equal
parent, type and value: the first by path is the renamed one, the other was removed.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from patchloom.functions.arrow import emit_rows
from patchloom.session import cut, join_small

#: One bit a kind, so that folding is a bitwise or.
KIND_BITS = {"boolean": 1, "integer": 2, "decimal": 4, "string": 8, "array": 16}

FIELD = T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
HEADER = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("workspace", T.StringType()),
        T.StructField("written_at", T.TimestampNTZType()),
        T.StructField("fields", T.ArrayType(FIELD)),
    ]
)


def kind_of(value) -> tuple[str | None, str | None]:
    """Kind of a leaf and its canonical text: equal values have equal texts, whatever the layout."""
    if value is None:
        return None, None
    if isinstance(value, bool):
        return "boolean", "true" if value else "false"
    if isinstance(value, int):
        return "integer", str(value)
    if isinstance(value, float):
        return "decimal", repr(value)
    if isinstance(value, str):
        return "string", value
    return "array", json.dumps(value, sort_keys=True, ensure_ascii=False)


def leaves(document: dict) -> list[tuple[str, str | None, str | None]]:
    """Dotted path, kind and text of each value that is not an object."""
    out, todo = {}, [("", document)]
    while todo:
        prefix, node = todo.pop()
        for key, value in node.items():
            path = f"{prefix}.{key}" if prefix else key
            if isinstance(value, dict):
                todo.append((path, value))
            else:
                out[path] = kind_of(value)
    return [(path, *kind) for path, kind in out.items()]


def _no_json(name: str):
    raise ValueError(f"{name} is not JSON")


def read_header(body: str | None) -> list[tuple] | None:
    if body is None:
        return None
    try:
        document = json.loads(body.removeprefix("﻿"), parse_constant=_no_json)
    except (ValueError, RecursionError):
        return None
    return leaves(document) if isinstance(document, dict) else None


def headers(files: DataFrame) -> DataFrame:
    """Header schema of each valid file, read where the file lies. `files`: file_id, workspace, written_at, body."""

    def visit(file_id, workspace, written_at, body):
        if (fields := read_header(body)) is not None:
            yield file_id, workspace, written_at, [{"path": p, "kind": k, "value": v} for p, k, v in fields]

    return emit_rows(files.select("file_id", "workspace", F.col("written_at").cast("timestamp_ntz"), "body"), visit, HEADER)


def promoted(bits: Column) -> Column:
    """Least upper bound in the lattice boolean | integer < decimal | array < string, as the name of a Spark type."""
    alone = {"boolean": "boolean", "integer": "bigint", "array": "array<string>"}
    out = F.when(bits == KIND_BITS["decimal"], "double").when(bits == KIND_BITS["integer"] | KIND_BITS["decimal"], "double")
    for kind, to in alone.items():
        out = out.when(bits == KIND_BITS[kind], to)
    return out.otherwise("string")


def fold_schemas(heads: DataFrame) -> DataFrame:
    """The union schema: path, kind_bits, type, n_files. Folds map-side; one row a path leaves each task."""
    bit = F.coalesce(*[F.when(F.col("f.kind") == k, b) for k, b in KIND_BITS.items()], F.lit(0))
    folded = (
        heads.select("file_id", F.explode("fields").alias("f"))
        .groupBy(F.col("f.path").alias("path"))
        .agg(F.bit_or(bit).alias("kind_bits"), F.count(F.lit(1)).alias("n_files"))
    )
    return folded.select("path", "kind_bits", promoted(F.col("kind_bits")).alias("type"), "n_files")


def union_schema(heads: DataFrame) -> DataFrame:
    """The union schema with a number for each field, in the order of paths, and its parent's path."""
    parent = F.expr("left(path, length(path) - length(substring_index(path, '.', -1)))")
    held = cut(fold_schemas(heads).orderBy("path").withColumn("field_no", F.monotonically_increasing_id()), "union")
    return held.withColumn("parent", parent)


def conformed(heads: DataFrame, union: DataFrame) -> DataFrame:
    """A row a file and field of the union schema that it mentions: the file's columns, field_no, parent, type, kind, value.

    The value stays as it was told, with its own kind: 4 and 4.0 differ, whatever type the field has in the union. The
    union schema is broadcast only after counting.
    """
    told = heads.select(*[c for c in heads.columns if c != "fields"], F.inline("fields"))
    return join_small(told, union.select("path", "field_no", "parent", "type"), ["path"])


def column_names(paths: list[str], taken: set[str]) -> dict[str, str]:
    """A column name for each path, unlike any other but for case (Spark's names have none) and unlike `taken`."""
    names, used = {}, {x.lower() for x in taken}
    for path in sorted(paths):
        base = name = path.replace(".", "__")
        n = 2
        while name.lower() in used:
            name, n = f"{base}__{n}", n + 1
        used.add(name.lower())
        names[path] = name
    return names


def once(heads: DataFrame) -> DataFrame:
    """Each file once, in its workspace's order: `ord`, and the id of the file after it (`has_next`, `next_id`).

    Files of a null id are told apart by their fields.
    """
    by_file = Window.partitionBy("workspace").orderBy("written_at", "file_id", "_told")
    x = heads.withColumn("_told", F.when(F.col("file_id").isNull(), F.xxhash64("fields")))
    same = F.lag("file_id").over(by_file).eqNullSafe(F.col("file_id")) & F.lag("_told").over(by_file).eqNullSafe(F.col("_told"))
    x = x.withColumn("_again", same & (F.row_number().over(by_file) > 1)).where("NOT _again")
    x = x.withColumn("ord", F.row_number().over(by_file)).withColumn("has_next", F.lead(F.lit(True)).over(by_file).isNotNull())
    return x.withColumn("next_id", F.lead("file_id").over(by_file)).drop("_again", "_told")


def unified(heads: DataFrame) -> DataFrame:
    """One consistent table: each file cast to the union schema, a column a field (dots become `__`).

    However many fields drift in, each becomes a column. A row's fields are put under their columns in one pass over what
    the file holds; the casts are the JVM's. `heads` is cut from its lineage.
    """
    schema = {r["path"]: r["type"] for r in fold_schemas(heads).orderBy("path").collect()}  # what the table's header must hold
    own = ["file_id", "workspace", "written_at"]
    names = column_names(list(schema), set(own))
    files = once(heads).select(*own, "fields")
    texts = T.StructType([*[files.schema[c] for c in own], *[T.StructField(names[p], T.StringType()) for p in schema]])
    place = {p: i for i, p in enumerate(schema)}
    arrow = to_arrow_schema(texts)

    def spread(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                fields = part.column(3).flatten()
                paths, values = fields.field("path").dictionary_encode(), fields.field("value")
                at = np.full((len(paths.dictionary), part.num_rows), -1)  # where the value of a field and row stands
                at[paths.indices.to_numpy(), pc.list_parent_indices(part.column(3)).to_numpy()] = np.arange(len(fields))
                told = [pa.nulls(part.num_rows, pa.string())] * len(place)
                for where, path in zip(at, paths.dictionary.to_pylist()):
                    told[place[path]] = values.take(pa.array(where, mask=where < 0)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *told], schema=arrow)

    def cast(path: str, to: str) -> Column:
        text = F.col(f"`{names[path]}`")
        return (F.from_json(text, to) if to.startswith("array") else text.try_cast(to)).alias(names[path])

    return files.mapInArrow(spread, texts).select(*own, *[cast(p, to) for p, to in schema.items()])


def changes(heads: DataFrame) -> DataFrame:
    """Ordered differences of each workspace's files: file_id, field, change_kind. `heads` is cut from its lineage.

    Schemas are folded through the lattice into the union schema, files cast to it, and their differences read off in the
    order of files. One shuffle of fields, on `workspace`; every window below keeps to it, and orders by numbers. A field's
    mentions in successive files form an island; what an island's last non-null mention said is the field's state, and a
    gap after it is a removal.
    """
    union = union_schema(heads)
    x = conformed(once(heads), union).select("workspace", "file_id", "ord", "has_next", "next_id", "field_no", "path", "parent", "kind", "value")
    by_path = Window.partitionBy("workspace", "field_no").orderBy("ord")
    step = F.when(F.col("ord") - F.lag("ord").over(by_path) == 1, 0).otherwise(1)
    x = x.withColumn("_step", step).withColumn("_next", F.lead("ord").over(by_path)).withColumn("island", F.sum("_step").over(by_path))
    said = F.when(F.col("kind").isNotNull(), F.struct("kind", "value"))
    earlier = Window.partitionBy("workspace", "field_no", "island").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("was", F.last(said, ignorenulls=True).over(earlier)).withColumn("now", F.coalesce(said, "was"))

    def event(when: Column, file_id: Column, at: Column, what: str, state: Column) -> Column:
        return F.when(when, F.struct(file_id.alias("file_id"), at.alias("at"), F.lit(what).alias("what"), state["kind"].alias("kind"), state["value"].alias("value")))

    c = F.col
    events = F.array_compact(
        F.array(
            event((c("ord") > 1) & c("kind").isNotNull() & c("was").isNull(), c("file_id"), c("ord"), "added", c("now")),
            event(c("kind").isNotNull() & (c("kind") != c("was")["kind"]), c("file_id"), c("ord"), "retyped", c("now")),
            event(c("has_next") & c("now").isNotNull() & (c("_next").isNull() | (c("_next") > c("ord") + 1)), c("next_id"), c("ord") + 1, "removed", c("now")),
        )
    )
    e = x.select("workspace", "field_no", "path", "parent", F.explode(events).alias("e")).select("workspace", "field_no", "path", "parent", "e.*")
    same = Window.partitionBy("workspace", "at", "parent", "kind", "value")
    count = lambda what: F.count(F.when(c("what") == what, 1)).over(same)
    e = e.withColumn("_added", count("added")).withColumn("_removed", count("removed"))
    e = e.withColumn("_rank", F.row_number().over(Window.partitionBy("workspace", "at", "parent", "kind", "value", "what").orderBy("field_no")))
    renamed = (c("what") == "added") & (c("_rank") <= c("_removed"))
    gone = (c("what") == "removed") & (c("_rank") <= c("_added"))
    return e.where(~gone).select("file_id", c("path").alias("field"), F.when(renamed, "renamed").otherwise(c("what")).alias("change_kind"))
