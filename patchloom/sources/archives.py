"""Archives as tables: the index of an outer tar, members of inner tars and zips, byte ranges.

Archives are opened where they lie and read by seeking: an index reads headers only, and each inner archive or zip member is
a row that any task can read by itself, so size is no limit. A path is one of the machine's or a URI pyarrow has a file
system for.
"""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512
INDEX = "archive STRING, name STRING, offset BIGINT, size BIGINT"
MEMBERS = "archive STRING, ord INT, name STRING, size BIGINT, content BINARY, error STRING"
LISTED = "archive STRING, ord INT, name STRING, size BIGINT, crc BIGINT, error STRING"


def open_at(path: str):
    """A readable file that seeks."""
    if re.match(r"^[a-z][a-z0-9+.-]*://", path) and not path.startswith("file://"):
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path)
        return system.open_input_file(place)
    return open(re.sub("^file:/*", "/", path), "rb")


def read_exact(file, offset: int, size: int) -> bytes:
    """Just `size` bytes from `offset`; fewer are an error."""
    file.seek(offset)
    data = file.read(size)
    if len(data) != size:
        raise EOFError(f"{len(data)} bytes instead of {size}")
    return data


def members(file, start: int = 0, size: int | None = None) -> Iterator[tuple[str, int, int]]:
    """Name, offset and size of the regular files of the tar in a part of a file, up to its first empty header or its end.

    By the ustar layout. Only headers are read; contents are skipped by seeking.
    """
    if size is None:
        size = file.seek(0, 2) - start
    at = start
    while at + BLOCK <= start + size:
        header = read_exact(file, at, BLOCK)
        if not header.strip(b"\0"):
            return
        name = header[:100].rstrip(b"\0").decode()
        prefix = header[345:500].rstrip(b"\0").decode() if header[257:262] == b"ustar" else ""
        length = int(header[124:136].strip(b"\0 ") or b"0", 8)
        if header[156:157] in (b"0", b"\0"):
            yield (f"{prefix}/{name}" if prefix else name), at + BLOCK, length
        at += BLOCK + (length + BLOCK - 1) // BLOCK * BLOCK


def index(archives: DataFrame) -> DataFrame:
    """Regular members of each tar. `archives`: path."""

    def run(batches):
        for batch in batches:
            for path in batch["path"]:
                with open_at(path) as f:
                    yield pd.DataFrame([(path, *m) for m in members(f)], columns=["archive", "name", "offset", "size"])

    return archives.select("path").mapInPandas(run, INDEX)


def extract_tar(archives: DataFrame, most: int | None = None, take_bytes: int | None = None) -> DataFrame:
    """Members with their contents, in archive order, up to `most` and within the first `take_bytes` of the archive.

    `archives`: path; of inner archives also `offset` and `size` in the file at path, and `take_bytes` of their own. Nothing
    is read beyond the last member taken; one that `take_bytes` cut through is dropped. An archive without members gives a
    row with an error, as does one that cannot be read. A member is a row of its own, so no more than one is held at a time.
    """
    has = set(archives.columns)
    given = lambda name: F.col(name) if name in has else F.lit(None)
    parts = archives.select("path", given("offset").cast("bigint").alias("offset"), given("size").cast("bigint").alias("size"), given("take_bytes").cast("bigint").alias("take_bytes"))
    columns = ["archive", "ord", "name", "size", "content", "error"]

    def run(batches):
        for batch in batches:
            for path, offset, size, take in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                n = 0
                try:
                    with open_at(path) as f:
                        start, length = int(offset or 0), size
                        length = int(length) if length is not None else f.seek(0, 2) - start
                        length = min(length, *(int(x) for x in (take, take_bytes) if x is not None), length)
                        for name, at, n_bytes in members(f, start, length):
                            if at + (n_bytes + BLOCK - 1) // BLOCK * BLOCK > start + length or most is not None and n >= most:
                                break
                            yield pd.DataFrame([(path, n, name, n_bytes, read_exact(f, at, n_bytes), None)], columns=columns)
                            n += 1
                    error = None if n else "no whole member"
                except (OSError, EOFError, ValueError) as e:
                    error = str(e)[:1000]
                if error:
                    yield pd.DataFrame([(path, n, None, None, None, error)], columns=columns)

    return parts.mapInPandas(run, MEMBERS)


def safe_member(name: str) -> bool:
    """A path of just two parts, below its archive's folder."""
    path = PurePosixPath(name)
    return len(path.parts) == 2 and not path.is_absolute() and ".." not in path.parts and "\\" not in name


def list_zip(archives: DataFrame, expected: int | None = None) -> DataFrame:
    """Members of zips by their directories; a wrong number, a name twice or an unsafe one is an error row. `archives`: path."""

    def read(path: str) -> list[tuple]:
        try:
            with open_at(path) as f, zipfile.ZipFile(f) as z:
                infos = [i for i in z.infolist() if not i.is_dir()]
        except (zipfile.BadZipFile, EOFError, OSError) as e:
            return [(path, 0, None, None, None, str(e)[:1000])]
        names = [i.filename for i in infos]
        if len(set(names)) < len(names):
            return [(path, 0, None, None, None, "a name occurs twice")]
        if bad := [n for n in names if not safe_member(n)]:
            return [(path, 0, bad[0], None, None, "unsafe path")]
        if expected is not None and len(names) != expected:
            return [(path, 0, None, None, None, f"{len(names)} members, {expected} expected")]
        return [(path, i, info.filename, info.file_size, info.CRC, None) for i, info in enumerate(infos)]

    def run(batches):
        for batch in batches:
            for path in batch["path"]:
                yield pd.DataFrame(read(path), columns=["archive", "ord", "name", "size", "crc", "error"])

    return archives.select("path").mapInPandas(run, LISTED)


def extract_zip(archives: DataFrame, expected: int | None = None, present: DataFrame | None = None, tasks: int = 64) -> DataFrame:
    """Members of zips with their contents, checked by CRC; a broken member is an error row, as what `list_zip` finds.

    Members are dealt to `tasks` by hash, and each task opens the archive once and seeks to its own. Those `present` (name,
    size, content) with the same size and CRC are left out.
    """
    listed = list_zip(archives, expected)
    if present is not None:
        listed = missing_members(listed, present)
    dealt = listed.repartition(tasks, "archive", "ord")
    columns = ["archive", "ord", "name", "size", "content", "error"]

    def run(batches):
        for batch in batches:
            for path, rows in batch.groupby("archive", sort=False):
                ok = rows[rows["error"].isna()].sort_values("ord")
                if len(ok) < len(rows):
                    yield rows[rows["error"].notna()].assign(content=None)[columns]
                if not len(ok):
                    continue
                with open_at(path) as f, zipfile.ZipFile(f) as z:
                    for r in ok.itertuples():
                        try:
                            content, error = z.read(r.name), None
                        except (zipfile.BadZipFile, zlib.error, EOFError) as e:
                            content, error = None, str(e)[:1000]
                        yield pd.DataFrame([(path, r.ord, r.name, r.size, content, error)], columns=columns)

    return dealt.mapInPandas(run, MEMBERS)


def missing_members(listed: DataFrame, present: DataFrame) -> DataFrame:
    """Members (name, size, crc) that are not there with the same size and CRC: what is left to extract, errors among it."""
    return listed.join(present.select("name", "size", F.crc32("content").alias("crc")), ["name", "size", "crc"], "left_anti")


def check_range(status: int, headers: dict[str, str], first: int, length: int, etag: str | None) -> None:
    """An answer to a range request must be partial, of the range asked for, and of the same version."""
    if status != 206:
        raise ValueError(f"status {status} instead of 206")
    found = re.fullmatch(r"bytes (\d+)-(\d+)/(\d+)", headers.get("content-range", ""))
    if not found or (int(found[1]), int(found[2])) != (first, first + length - 1):
        raise ValueError("another range than asked for")
    if etag is not None and headers.get("etag") != etag:
        raise ValueError("the file has changed")
    if int(headers.get("content-length", length)) != length:
        raise ValueError("another length than asked for")
