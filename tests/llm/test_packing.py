import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patchloom.llm import packing


def check(sizes, container, start, capacity):
    for k in np.unique(container):
        spans = sorted((s, s + n) for s, n, c in zip(start, sizes, container) if c == k)
        assert spans[0][0] == 0 and spans[-1][1] <= capacity
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])), "no overlap and no gap"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=120))
def test_every_item_is_placed_whole(sizes):
    sizes = np.array(sorted(sizes, reverse=True))
    container, start, _ = packing.fewest(sizes, 50, 64)
    check(sizes, container, start, 50)
    assert set(container) == set(range(container.max() + 1))
    assert container.max() + 1 <= max(1, 2 * sizes.sum() / 50 + 1)


def test_containers_are_nearly_full_and_costs_even():
    rng = np.random.default_rng(0)
    sizes = np.sort(np.minimum(rng.lognormal(5.5, 1, 5000).astype(int) + 1, 2048))[::-1]
    container, start, _ = packing.fewest(sizes, 2048, 1024)
    check(sizes, container, start, 2048)
    assert sizes.sum() / ((container.max() + 1) * 2048) > 0.995
    costs = np.bincount(container, weights=sizes + sizes**2 / 6144)
    assert costs.std() / costs.mean() < 0.15


@pytest.mark.parametrize("shard_tokens", [300, 10**9])
def test_table(spark, shard_tokens):
    n = [0, None, 1, 100, 100, 101, 250, 100, 37, 63, 0] + [20] * 30
    rows = [(i, x, 1.0) for i, x in enumerate(n)] + [(3, 100, 1.0)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, n_tokens BIGINT, piece DOUBLE").drop("piece")
    out = packing.pack(df, capacity=100, shard_tokens=shard_tokens).collect()
    assert {r["doc_id"] for r in out} == set(range(len(n)))
    assert sorted((r["doc_id"], r["piece"], r["n_tokens"]) for r in out if r["n_pieces"] > 1) == [(5, 0, 100), (5, 1, 1), (6, 0, 100), (6, 1, 100), (6, 2, 50)]
    assert all((r["container"] is None) == (r["n_tokens"] == 0) for r in out)
    full = [r for r in out if r["container"] is not None]
    check([r["n_tokens"] for r in full], [r["container"] for r in full], [r["start"] for r in full], 100)
    assert sum(r["n_tokens"] for r in out) == sum(x or 0 for x in n) + 100
    if shard_tokens > 300:
        assert len({r["container"] for r in full}) == math.ceil(sum(r["n_tokens"] for r in full) / 100)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id BIGINT, n_tokens BIGINT")).count() == 0
