"""Cost-balanced packing of texts into containers of a fixed capacity.

The cost of a text of L tokens is linear plus quadratic in L (the quadratic part is attention within the text). Texts are
spread over shards of about `shard_tokens` tokens; in each, they are taken in descending order, and each goes to the
container of lowest cost that has room left; a new one is opened only if none has. Balancing leaves every container a
little room, too little for what comes last; so the last, smallest texts go where least room is left instead, as many of
them as it takes to need fewest containers (see `fewest`). A text of more than the capacity is split into full containers and a rest; no other is split.

Defined results. A text without tokens (null or empty) takes no space: its container is null. Ties are broken by size, then
id, then piece. A shard is bounded, whatever the data; all rows are packed. Empty input gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
PACKED = "doc_id BIGINT, piece INT, n_pieces INT, n_tokens BIGINT, container BIGINT, start BIGINT, cost_share DOUBLE"


def assign(sizes: np.ndarray, capacity: int, hidden: int, share: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Container and start of each item; `sizes` descend, all in 1..capacity.

    The first `share` of all tokens go to the container of lowest cost with room, the rest to the one of least room.
    """
    costs = sizes + sizes.astype(float) ** 2 / (6 * hidden)
    by_cost = np.searchsorted(np.cumsum(sizes), share * sizes.sum(), "right")
    open_ = max(1, math.ceil(sizes.sum() / capacity))
    room = np.zeros(open_ + len(sizes), np.int64)
    room[:open_] = capacity
    load = np.zeros(len(room))
    container, start = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    live = np.arange(open_)
    least = sizes[-1] if len(sizes) else 1
    for i, (size, cost) in enumerate(zip(sizes.tolist(), costs.tolist())):
        if i % 512 == 0:
            live = live[room[live] >= least]  # full ones are not looked at again
        left = room[live]
        fits = left >= size
        if fits.any():
            k = live[np.argmin(np.where(fits, load[live] if i < by_cost else left, np.inf))]
        else:
            k, open_ = open_, open_ + 1
            room[k] = capacity
            live = np.append(live, k)
        container[i], start[i] = k, capacity - room[k]
        room[k] -= size
        load[k] += cost
    return container, start


def fewest(sizes: np.ndarray, capacity: int, hidden: int, shares=(1.0, 0.9, 0.8, 0.65, 0.5, 0.0)) -> tuple[np.ndarray, np.ndarray, float]:
    """The assignment of fewest containers; of such, the one that places most tokens by cost, and the share it so places."""
    floor, best = math.ceil(sizes.sum() / capacity), None
    for share in shares:
        container, start = assign(sizes, capacity, hidden, share)
        if best is None or container.max() < best[0].max():
            best = container, start, share
        if best[0].max() + 1 <= floor:
            break
    return best


def pack(sizes: DataFrame, capacity: int = CAPACITY, hidden: int = 1024, shard_tokens: int = 4_000_000) -> DataFrame:
    """doc_id, piece, n_pieces, n_tokens, container, start, cost_share (of its shard, see `fewest`).

    `sizes`: doc_id, n_tokens, already cut from its lineage.
    """
    total = sizes.agg(F.sum("n_tokens")).head()[0] or 0
    shards = max(1, math.ceil(total / shard_tokens))
    sizes = sizes.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    n = F.col("n_tokens")
    last = F.greatest(F.lit(0).cast("bigint"), F.floor((n - 1) / capacity))
    pieces = sizes.withColumn("n_pieces", (last + 1).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(capacity), n - F.col("piece") * capacity))
    # repeated ids and the pieces of one long text spread evenly too
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(shards)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        container, start, share = fewest(group["n_tokens"].to_numpy(), capacity, hidden)
        shard = int(group["shard"].iloc[0])
        return group[["doc_id", "piece", "n_pieces", "n_tokens"]].assign(container=(shard << 32) + container, start=start, cost_share=share)

    packed = pieces.where("n_tokens > 0").groupBy("shard").applyInPandas(run, PACKED)
    none = pieces.where("n_tokens <= 0").select("doc_id", "piece", "n_pieces", F.lit(0).cast("bigint").alias("n_tokens"), F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("double").alias("cost_share"))
    return packed.unionByName(none)
