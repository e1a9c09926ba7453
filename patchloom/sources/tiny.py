"""Image records out of very small files: .jsonl, .json, .csv and .tsv, whole contents in a column.

Defined results. A record needs relative, size and mtime_ns, all readable: `relative` not empty (given as the plain posix
path), the numbers whole and within 64 bits, however noted. Null, empty and blank bodies hold no record. A .json file that
does not parse holds none; a .jsonl line that does not parse is none; a .csv or .tsv row torn off (no line end after it, an
open quote, too few fields) is none, nor is one with a quote out of place, and reading goes on with the line after the one
where it began. Files of other suffixes hold none. Columns of no header stand in the order FIELDS.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from patchloom.functions.arrow import emit_rows

FIELDS = ["path", "relative", "size", "mtime_ns", "key"]
RECORD = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("relative", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime_ns", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("path", T.StringType()),
    ]
)


def whole(value) -> int | None:
    """A whole number within 64 bits, noted as a number or text (plain, fraction of zeros, exponent, grouped by , or _)."""
    if value is None or isinstance(value, bool):
        return None
    if isinstance(value, str):
        value = value.strip()
        if not re.fullmatch(r"[+-]?\d+", value):
            value = re.sub(r"(?<=\d)[,_](?=\d{3}(?!\d))", "", value)
    try:
        number = Decimal(value)
        if number != number.to_integral_value():
            return None
        number = int(number)
    except (InvalidOperation, ValueError, TypeError, OverflowError):
        return None
    return number if -(2**63) <= number < 2**63 else None


def record(fields) -> tuple | None:
    """(relative, size, mtime_ns, key, path) of a mapping, or None."""
    if not isinstance(fields, dict):
        return None
    relative, size, mtime = fields.get("relative"), whole(fields.get("size")), whole(fields.get("mtime_ns"))
    if not isinstance(relative, str) or not relative.strip() or size is None or mtime is None:
        return None
    text = lambda k: v if isinstance(v := fields.get(k), str) and v else None
    return str(PurePosixPath(relative)), size, mtime, text("key"), text("path")


def _json(text: str):
    try:
        return json.loads(text, parse_float=Decimal)
    except (ValueError, RecursionError):
        return None


def _complete_rows(body: str, delimiter: str) -> Iterator[list[str]]:
    """Rows that parse and end with a line end. After one that does not parse, reading starts anew on its second line."""
    csv.field_size_limit(2**31 - 1)
    lines = list(io.StringIO(body, newline=""))
    first = taken = 0

    def feed():
        nonlocal taken
        while taken < len(lines):
            taken += 1
            yield lines[taken - 1]

    while first < len(lines):
        taken = first
        try:
            for row in csv.reader(feed(), delimiter=delimiter, strict=True):
                first = taken
                if row and lines[taken - 1].endswith(("\n", "\r")):
                    yield row
            return
        except csv.Error:
            first += 1


def _rows(body: str, delimiter: str) -> Iterator[dict]:
    names: list[str] = []
    for row in _complete_rows(body, delimiter):
        if not names:
            heads = [x.strip().lower() for x in row]
            is_header = set(heads) <= set(FIELDS) and "relative" in heads
            names = heads if is_header else FIELDS
            if is_header:
                continue
        if len(row) == len(names):
            yield dict(zip(names, row))


def records_of(file_path: str | None, body: str | None) -> Iterator[tuple]:
    """The records of one file, in its order, repeats included."""
    if not body or not file_path:
        return
    body, suffix = body.removeprefix("﻿"), file_path.rpartition(".")[2].lower()
    if suffix == "jsonl":
        found = (_json(line) for line in re.split(r"\r\n|\n|\r", body) if line.strip())
    elif suffix == "json":
        whole_file = _json(body)
        found = whole_file if isinstance(whole_file, list) else [whole_file]
    elif suffix in ("csv", "tsv"):
        found = _rows(body, "," if suffix == "csv" else "\t")
    else:
        return
    for fields in found:
        if (r := record(fields)) is not None:
            yield r


def read_tiny(files: DataFrame, combine: int = 0) -> DataFrame:
    """All complete records of `files` (file_id, file_path, body; other columns are ignored), repeats included.

    With `combine`, a task leaves out a record if it is among the up to `combine` different ones it has last emitted: a
    record delivered over and over then doesn't go through a shuffle each time. It stays at least once in every task.
    """
    seen: set = set()

    def visit(file_id, file_path, body):
        for r in records_of(file_path, body):
            if combine:
                if r in seen:
                    continue
                if len(seen) >= combine:
                    seen.clear()
                seen.add(r)
            yield file_id, *r

    return emit_rows(files.select("file_id", "file_path", "body"), visit, RECORD)
