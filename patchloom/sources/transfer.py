"""Transfers that go on where they broke off. The transport is injected, so nothing here needs a network.

A transport is a function of (offset, length or None) that gives an `Answer`: of a whole file for offset 0 and no length, of
a byte range else.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.sources.archives import BLOCK, check_range, members


@dataclass
class Answer:
    status: int
    headers: dict[str, str]
    blocks: Iterator[bytes]
    closed: list = field(default_factory=list)


Transport = Callable[[int, int | None], Answer]


def http(url: str, etag: str | None = None, timeout: float = 90) -> Transport:
    """The transport of a URL; a range is asked for on condition that the file is still of the version `etag`."""
    from urllib.request import Request, urlopen

    def answer(offset: int, length: int | None) -> Answer:
        headers = {} if length is None else {"Range": f"bytes={offset}-{offset + length - 1}"} | ({"If-Range": etag} if etag else {})
        response = urlopen(Request(url, headers=headers), timeout=timeout)
        return Answer(response.status, {k.lower(): v for k, v in response.headers.items()}, iter(lambda: response.read(1 << 20), b""))

    return answer


def local(path: str) -> Transport:
    """The transport of a file that is there: ranges of it, of the version `local`."""
    from patchloom.sources.archives import open_at

    def answer(offset: int, length: int | None) -> Answer:
        with open_at(path) as f:
            total = f.seek(0, 2)
            f.seek(offset)
            data = f.read(total if length is None else length)
        tail = {"content-range": f"bytes {offset}-{offset + len(data) - 1}/{total}"} if length is not None else {}
        return Answer(200 if length is None else 206, {"etag": "local", "content-length": str(len(data))} | tail, iter([data]))

    return answer


def resume(transport: Transport, path: str | Path, total: int, etag: str, valid: Callable[[Path], bool], progress: Callable[[int, float], None] | None = None) -> bool:
    """Have the whole file at `path`: keep a valid one, go on with a part, or begin. Tells whether anything was transferred.

    The part lies beside as `.part` and stays when a transfer breaks off or the server refuses; it is renamed when whole and
    valid. A file of another version (tag or size) is an error, as is a part larger than the whole.
    """
    path = Path(path)
    if path.is_file() and path.stat().st_size == total and valid(path):
        return False
    path.unlink(missing_ok=True)
    part = path.with_name(f"{path.name}.part")
    path.parent.mkdir(parents=True, exist_ok=True)
    have = part.stat().st_size if part.exists() else 0
    if have > total:
        raise ValueError(f"{part} is larger than the whole; remove it")
    if have < total:
        answer = transport(have, total - have if have else None)
        if have:
            check_range(answer.status, answer.headers, have, total - have, etag)
        elif answer.status != 200 or answer.headers.get("etag") != etag or int(answer.headers.get("content-length", -1)) != total:
            raise ValueError("the file has changed, or is refused")
        began = time.monotonic()
        with open(part, "ab") as f:
            for block in answer.blocks:
                f.write(block)
                have += len(block)
                if progress:
                    progress(have, time.monotonic() - began)
            f.flush()
            os.fsync(f.fileno())
    if have != total:
        raise EOFError(f"{have} of {total} bytes")
    if not valid(part):
        raise ValueError(f"{part} is whole but not valid")
    os.replace(part, path)
    return True


class Ranged:
    """A file behind a transport, which seeks: each read is a checked byte range, ahead by a block."""

    def __init__(self, transport: Transport, size: int, etag: str, ahead: int = 1 << 20):
        self.transport, self.size, self.etag, self.ahead = transport, size, etag, ahead
        self.at, self.held_at, self.held = 0, 0, b""
        self.transferred = 0

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (self.size if whence == 2 else self.at if whence == 1 else 0)
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = max(0, min(n if n >= 0 else self.size, self.size - self.at))
        if not (self.held_at <= self.at and self.at + n <= self.held_at + len(self.held)):
            length = min(max(n, self.ahead), self.size - self.at)
            if not length:
                return b""
            answer = self.transport(self.at, length)
            check_range(answer.status, answer.headers, self.at, length, self.etag)
            self.held_at, self.held = self.at, b"".join(answer.blocks)
            self.transferred += len(self.held)
            if len(self.held) != length:
                raise EOFError(f"{len(self.held)} of {length} bytes")
        out = self.held[self.at - self.held_at : self.at - self.held_at + n]
        self.at += n
        return out


GROUP = "name STRING, images BIGINT, image_bytes BIGINT, bytes_read BIGINT, error STRING"


def fetch_groups(plan: DataFrame, make: Callable[[], Transport], total: int, etag: str, folder: str, most: int | None = None) -> DataFrame:
    """Images of each group of a plan (name, offset, take_bytes) fetched into `folder`/group, and a receipt a group.

    A group is a row, fetched by whichever task has it: no more than `take_bytes` and `most` images, the last one whole.
    Images that are there with their size are not written again. A group without images, or of fewer than `most` where so
    many are asked for, is an error in its row. `folder` is on a file system all executors mount.
    """

    def fetch(name: str, offset: int, take: int, transport: Transport) -> tuple:
        group = name.removesuffix(".tar")
        file, n, n_bytes, end = Ranged(transport, min(total, offset + take), etag), 0, 0, offset
        try:
            for member, at, size in members(file, offset, take):
                padded = at + -(-size // BLOCK) * BLOCK
                if padded > offset + take or most is not None and n == most:
                    break
                target = Path(folder) / group / Path(member).name
                if not (target.is_file() and target.stat().st_size == size):
                    target.parent.mkdir(parents=True, exist_ok=True)
                    file.seek(at)
                    beside = target.with_name(f".{target.name}.part")
                    beside.write_bytes(file.read(size))
                    os.replace(beside, target)
                n, n_bytes, end = n + 1, n_bytes + size, padded
        except (EOFError, ValueError, OSError) as e:
            return name, n, n_bytes, end - offset, str(e)[:1000]
        short = "no whole image" if not n else f"{n} of {most} images" if most is not None and n < most else None
        return name, n, n_bytes, end - offset, short

    def run(batches):
        transport = make()
        for batch in batches:
            for name, offset, take in batch.itertuples(index=False):
                yield pd.DataFrame([fetch(name, int(offset), int(take), transport)], columns=["name", "images", "image_bytes", "bytes_read", "error"])

    return plan.select("name", "offset", "take_bytes").repartition(F.col("name")).mapInPandas(run, GROUP)
