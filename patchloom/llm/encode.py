"""Encoding of a whole corpus by content-defined chunk reuse.

A rolling hash over the bytes before each line end decides where chunks end, so that equal passages of different documents
yield equal chunks. A worker encodes a chunk once and takes it from its memory when it comes again, in whatever document
or task. Such a chunk end lies between a visible ASCII character and white space: no piece of the vocabulary's pattern
reaches across such a place, whatever surrounds it, so ids on both sides stand. A stretch of more than `LONGEST` bytes
without one is cut at the last such place it has, or else at a character, and then the join is repaired: tokens on both
sides are taken back to the nearest such places and re-encoded together, further and further out until both ends agree.

Neither texts, chunks nor ids go through a shuffle. Sharing chunks between workers was measured: nine tenths of the bytes
are of chunks that occur once, and joining the rest costs more than encoding it again (README).

Defined results. Null and empty texts have an empty list. Repeated rows each keep their row. Special tokens' strings are
ordinary text. Very long texts are read whole. Empty input gives an empty table.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from patchloom.llm.tokens import FOLDER, encoder, ids_of

#: A line end is a chunk end if the low bits of the hash are zero: one in so many.
EVERY = 2
#: Bytes the rolling hash sees, and the most bytes of a chunk.
WINDOW, LONGEST = 16, 8192
#: Bytes of chunks and ids that a worker remembers at most, twice.
REMEMBERED = 32 << 20
_GEAR = np.random.default_rng(2024).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
_SPACE = np.isin(np.arange(256), [9, 10, 13, 32])
_LINE_END = np.isin(np.arange(256), [10, 13])
_VISIBLE = (np.arange(256) >= 0x21) & (np.arange(256) <= 0x7E)


_GEAR[0] = 0  # zero bytes stand between texts that are hashed together; they leave no trace


def chosen_places(data: np.ndarray) -> np.ndarray:
    """Positions between a visible ASCII character and a line end at which the hash of the WINDOW bytes before ends a chunk."""
    places = np.flatnonzero(_LINE_END[data])
    places = places[places > 0]
    places = places[_VISIBLE[data[places - 1]]]
    h = np.zeros(len(places), np.uint32)
    for back in range(WINDOW):
        at = places - 1 - back
        h += np.where(at >= 0, _GEAR[data[np.maximum(at, 0)]], np.uint32(0)) << np.uint32(back)
    return places[(h >> np.uint32(WINDOW - 4)) % np.uint32(EVERY) == 0]


def cut_text(data: np.ndarray, chosen: list[int], longest: int = LONGEST) -> tuple[list[int], list[bool]]:
    """End of each chunk of a text's bytes, and whether it is safe. Chunks over `longest` are cut again."""
    if not chosen and len(data) <= longest:
        return [len(data)], [True]
    ends, safe, last = [], [], 0
    for end in [*chosen, len(data)]:
        while end - last > longest:
            part = data[last : last + longest + 1]
            near = np.flatnonzero(_VISIBLE[part[:-1]] & _SPACE[part[1:]])
            last = last + int(near[-1]) + 1 if len(near) else last + longest
            while not len(near) and data[last] & 0xC0 == 0x80:  # not within a character
                last -= 1
            ends.append(last)
            safe.append(bool(len(near)))
        if end > last:
            ends.append(end)
            safe.append(True)
            last = end
    return ends, safe


def chunk_ends(raw: bytes, longest: int = LONGEST) -> tuple[list[int], list[bool]]:
    data = np.frombuffer(raw, np.uint8)
    return cut_text(data, chosen_places(data).tolist(), longest)


def chunk_many(raws: list[bytes]) -> list[tuple[list[int], list[bool]]]:
    """`chunk_ends` of many texts; what doesn't depend on the text is done once for all."""
    gap = bytes(WINDOW)
    data = np.frombuffer(gap.join(raws) + gap, np.uint8)
    starts = np.cumsum([0, *(len(r) + WINDOW for r in raws)])
    chosen = chosen_places(data)
    cut_at = np.searchsorted(chosen, starts)
    return [cut_text(data[lo : lo + len(r)], (chosen[cut_at[i] : cut_at[i + 1]] - lo).tolist()) for i, (r, lo) in enumerate(zip(raws, starts.tolist()))]


def slices(batch: pa.RecordBatch, rows: int = 200, size: int = 4 << 20):
    """Parts of a batch of up to `rows` rows and about `size` bytes, or of one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


class Memory:
    """Ids of the chunks seen, of up to `most` bytes twice: when the younger half is full it becomes the older one."""

    def __init__(self, encode, most: int = REMEMBERED):
        self.encode, self.most = encode, most
        self.young: dict[bytes, np.ndarray] = {}
        self.old: dict[bytes, np.ndarray] = {}
        self.held = 0

    def ids(self, chunk: bytes) -> np.ndarray:
        found = self.young.get(chunk)
        if found is not None:
            return found
        found = self.old.get(chunk)
        if found is None:
            found = self.encode(chunk.decode())
        self.young[chunk] = found
        self.held += len(chunk) + found.nbytes + 200
        if self.held > self.most:
            self.young, self.old, self.held = {}, self.young, 0
        return found


@functools.cache
def memory(folder: str, name: str) -> Memory:
    """One a worker: it outlives the task."""
    return Memory(ids_of(folder, name))


def repair(parts: list[list[int]], safe: list[bool], enc) -> list[int]:
    """Ids of a text from those of its chunks; `safe[i]` tells whether the end of part i needs no repair."""
    whole: list[int] = []
    pending: list[int] = []  # tokens since the last safe place of which the encoding isn't settled
    open_end = False
    size = enc.decode_single_token_bytes
    for ids, ok in zip(parts, safe):
        if not open_end:
            whole += pending
            pending = list(ids)
        else:
            # out to the left until a safe place is reached, out to the right likewise, then encode what lies between
            lo, left = len(pending), b""
            while lo and not _starts_safely(left, pending, lo, size):
                lo -= 1
                left = size(pending[lo]) + left
            hi, right = 0, b""
            while hi < len(ids) and not _ends_safely(right, ids, hi, size):
                right += size(ids[hi])
                hi += 1
            middle = enc.encode_ordinary((left + right).decode())
            pending = pending[:lo] + middle + list(ids[hi:])
        open_end = not ok
    return whole + pending


def _starts_safely(left: bytes, tokens: list[int], lo: int, size) -> bool:
    """Between token lo - 1 and what was taken back lies a safe place."""
    return bool(left) and left[0] in b"\t\n\r " and 0x21 <= size(tokens[lo - 1])[-1] <= 0x7E


def _ends_safely(right: bytes, tokens: list[int], hi: int, size) -> bool:
    return bool(right) and 0x21 <= right[-1] <= 0x7E and size(tokens[hi])[0] in b"\t\n\r "


def encode(documents: DataFrame, folder: str = FOLDER, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, ids: a row a row of `documents` (doc_id, text; other columns are ignored). One pass, no shuffle."""
    schema = T.StructType([documents.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        enc, known = encoder(folder, name), memory(folder, name)
        for batch in batches:
            for part in slices(batch):
                raws = [(t.as_py() or "").encode() for t in part.column(1)]
                ids, sizes = [], []
                for raw, (ends, safe) in zip(raws, chunk_many(raws)):
                    parts = [known.ids(raw[a:b]) for a, b in zip([0, *ends], ends)] if raw else []
                    if not all(safe):
                        parts = [np.array(repair([p.tolist() for p in parts], safe, enc), np.uint32)]
                    ids += parts
                    sizes.append(sum(map(len, parts)))
                flat = np.concatenate(ids).view(np.int32) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists.cast(arrow.field("ids").type)], schema=arrow)

    return documents.select("doc_id", "text").mapInArrow(run, schema)
