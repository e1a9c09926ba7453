"""One-to-one pairing of proposals and references: as many pairs as possible, then the largest overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from patchloom.session import cut


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of the largest total gain (shortest augmenting paths with potentials)."""
    flipped = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flipped else gain)
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)  # row of each column; the last column is where a search begins
    for row in range(n):
        owner[m], col = row, m
        least, came, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m + 1, bool)
        while owner[col] >= 0:
            seen[col] = True
            r = owner[col]
            free = ~seen[:m]
            reduced = cost[r] - row_price[r] - col_price[:m]
            better = free & (reduced < least)
            least[better], came[better] = reduced[better], col
            nxt = int(np.argmin(np.where(free, least, np.inf)))
            step = least[nxt]
            row_price[owner[seen]] += step
            col_price[seen] -= step
            least[free] -= step
            col = nxt
        while col != m:
            owner[col] = owner[came[col]]
            col = came[col]
    pairs = [(int(owner[c]), c) for c in range(m) if owner[c] >= 0]
    return sorted((c, r) for r, c in pairs) if flipped else sorted(pairs)


def pair(candidates: DataFrame) -> DataFrame:
    """The pairing of each image from its candidate pairs (image, p, r, iou), all above the threshold.

    Images in which no box has two candidates are paired as they stand, in the JVM. The others go to Python as one row an
    image, many rows a batch; an image's candidates are those of a single picture.
    """
    both = candidates.groupBy("image").agg(F.collect_list(F.struct("p", "r", "iou")).alias("c"))
    plain = (F.size("c") == F.size(F.array_distinct("c.p"))) & (F.size("c") == F.size(F.array_distinct("c.r")))
    both = cut(both.withColumn("plain", plain), "candidates")
    names = ("image", "p", "r", "iou")
    schema = T.StructType([candidates.schema[n] for n in names])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            out = []
            for image, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ps, rs = sorted({x["p"] for x in found}), sorted({x["r"] for x in found})
                at_p, at_r = {p: i for i, p in enumerate(ps)}, {r: i for i, r in enumerate(rs)}
                iou = np.zeros((len(ps), len(rs)))
                for x in found:
                    iou[at_p[x["p"]], at_r[x["r"]]] = x["iou"]
                out += [(image, ps[i], rs[j], iou[i, j]) for i, j in best_assignment((iou > 0) * 1000 + iou) if iou[i, j] > 0]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    easy = F.transform("c", lambda x: F.struct("image", x["p"].alias("p"), x["r"].alias("r"), x["iou"].alias("iou")))
    solved = both.where(~F.col("plain")).select("image", "c").mapInArrow(run, schema)
    return both.where("plain").select(F.inline(easy)).unionByName(solved)
