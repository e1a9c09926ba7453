"""Scalars of paths, durations, hashes and headers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of image files, compared in lower case.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES)


def label_key(relative: Column) -> Column:
    """The path with its suffix replaced by .txt; a name without a suffix, or of a dot file, gets one added."""
    return F.when(relative.rlike(r"[^/.][^/]*\.[^./]+$"), F.regexp_replace(relative, r"\.[^./]+$", ".txt")).otherwise(F.concat(relative, F.lit(".txt")))


def first_part(relative: Column) -> Column:
    return F.split_part(relative, F.lit("/"), F.lit(1))


def clock(seconds: Column) -> Column:
    """HH:MM:SS, cut to whole seconds, never below zero; hours may exceed a day. A null stays null."""
    s = F.greatest(F.lit(0).cast("bigint"), seconds.cast("bigint"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(s / 3600).cast("string")
    hours = F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours)
    return F.when(seconds.isNotNull(), F.concat_ws(":", hours, two(F.floor(s % 3600 / 60)), two(s % 60)))


def content_range(header: Column) -> Column:
    """first, last and total of a Content-Range header; nulls where it isn't one."""
    part = lambda i: F.regexp_extract(header, r"^bytes (\d+)-(\d+)/(\d+)$", i).try_cast("bigint")
    return F.struct(part(1).alias("first"), part(2).alias("last"), part(3).alias("total"))


def subset_rank(seed, relative: Column) -> Column:
    """What orders a deterministic subset: the hash of seed and path, whatever order the rows come in."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), relative), 256)


def ends_as_jpeg(content: Column) -> Column:
    return F.right(F.hex(content), F.lit(4)) == "FFD9"
