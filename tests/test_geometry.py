import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchloom.functions import geometry as g
from patchloom.operators import assign, nms, quality
from patchloom.operators.spectral import CutSettings, components, discover, halves, refine, relaxed_cut, sized_parts

BOXES = "image BIGINT, ord INT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE"


def iou(a, b):
    side = lambda i, j: max(0.0, min(a[i] + a[j] / 2, b[i] + b[j] / 2) - max(a[i] - a[j] / 2, b[i] - b[j] / 2))
    shared = side(0, 2) * side(1, 3)
    union = a[2] * a[3] + b[2] * b[3] - shared
    return shared / union if union > 0 else 0.0


unit = st.integers(1, 12).map(lambda k: k / 12)
box = st.tuples(unit, unit, unit, unit)


@settings(max_examples=6, deadline=None)
@given(st.lists(box, min_size=1, max_size=12))
def test_suppression_and_candidates_agree_with_brute_force(spark, boxes):
    df = spark.createDataFrame([(1, i, *b) for i, b in enumerate(boxes)], BOXES)
    kept = []
    for i, b in enumerate(boxes):
        if all(iou(b, boxes[k]) <= 0.3 for k in kept):
            kept.append(i)
    assert sorted(r["ord"] for r in nms.suppress(df, [F.col("ord")], 0.3).collect()) == kept
    want = {(i, j) for i, a in enumerate(boxes) for j, b in enumerate(boxes) if iou(a, b) >= 0.2}
    found = [(r["p"], r["r"]) for r in nms.candidates(df, df, 0.2).collect()]
    assert sorted(found) == sorted(want)


def test_suppression_by_score_keeps_the_better(spark):
    df = spark.createDataFrame([(1, 0, 0.5, 0.5, 0.4, 0.4, 0.1), (1, 1, 0.5, 0.5, 0.4, 0.4, 0.9), (2, 0, 0.5, 0.5, 0.4, 0.4, 0.5)], BOXES + ", score DOUBLE")
    assert sorted((r["image"], r["ord"]) for r in nms.suppress(df, [-F.col("score"), F.col("ord")], 0.5).collect()) == [(1, 1), (2, 0)]


def test_validity_and_conversion(spark):
    rows = [(0.5, 0.5, 1.0, 1.0, True), (0.5, 0.5, 0.0, 1.0, False), (0.1, 0.5, 0.3, 0.5, False), (float("nan"), 0.5, 0.1, 0.1, False), (None, 0.5, 0.1, 0.1, False), (0.5, 0.5, 1.0 + 1e-8, 0.5, False)]
    df = spark.createDataFrame(rows, "x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, ok BOOLEAN")
    b = F.struct("x", "y", "w", "h")
    assert all(r["ok"] == r["v"] for r in df.select("ok", g.is_valid(b).alias("v")).collect())
    c = df.limit(1).select(g.corners(b, F.lit(40.0), F.lit(20.0)).alias("c")).collect()[0]["c"]
    assert tuple(c) == (0, 0, 40, 20)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 2**31))
def test_assignment_is_the_best(n, m, seed):
    gain = np.random.default_rng(seed).random((n, m)).round(2)
    gain[gain < 0.3] = 0
    gain = (gain > 0) * 1000 + gain
    pairs = assign.best_assignment(gain)
    assert len({p for p, _ in pairs}) == len({r for _, r in pairs}) == len(pairs) == min(n, m)
    rows, cols = (n, m) if n <= m else (m, n)
    table = gain if n <= m else gain.T
    best = max(sum(table[i, p[i]] for i in range(rows)) for p in itertools.permutations(range(cols), rows))
    assert abs(sum(gain[p, r] for p, r in pairs) - best) < 1e-9


def test_pairing_prefers_more_pairs(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.6), (1, 2, 1, 0.6), (2, 1, 1, 0.5)], "image BIGINT, p INT, r INT, iou DOUBLE")
    assert sorted(tuple(r)[:3] for r in assign.pair(df).collect()) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]


def test_mask_boxes_and_histogram(spark):
    masks = {0: [(2, 1), (2, 5), (7, 3)], 1: [(0, 0)], 2: [(r, c) for r in range(10) for c in range(16)]}
    cells = spark.createDataFrame([(4, k, r, c) for k, m in masks.items() for r, c in m], "image INT, mask INT, r INT, c INT")
    found = {r["mask"]: tuple(r)[2:] for r in nms.mask_boxes(cells, 10, 16).collect()}
    assert found == {0: (3.5 / 16, 0.5, 5 / 16, 0.6000000000000001), 1: (0.5 / 16, 0.05, 1 / 16, 0.1), 2: (0.5, 0.5, 1.0, 1.0)}
    v = spark.createDataFrame([(x,) for x in (0.0, 0.005, 0.75, 1.000001, 2.0, None)], "v DOUBLE")
    assert [r["n"] for r in quality.histogram(v, F.col("v"), quality.AREA_EDGES).orderBy("bin").collect()] == [1, 1, 0, 0, 0, 0, 0, 2]


def test_quality_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([], "n_boxes BIGINT, n_images BIGINT")
    assert tuple(quality.summary(empty).collect()[0]) == (0, 0, 0.0, 0.0, 0.0)
    two = spark.createDataFrame([(0, 1), (1, 1)], "n_boxes BIGINT, n_images BIGINT")
    assert tuple(quality.summary(two).collect()[0]) == (2, 1, 0.5, 0.5, 0.5)


def flood(mask):
    label, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if label[start]:
            continue
        n += 1
        todo = [start]
        while todo:
            r, c = todo.pop()
            if 0 <= r < mask.shape[0] and 0 <= c < mask.shape[1] and mask[r, c] and not label[r, c]:
                label[r, c] = n
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return label


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**31))
def test_components_agree_with_flood_fill(rows, cols, seed):
    mask = np.random.default_rng(seed).random((rows, cols)) < 0.6
    assert np.array_equal(components(mask), flood(mask))


def planted(side, spots):
    features = np.zeros((side, side, 2))
    features[..., 0] = 1
    for spot in spots:
        features[spot] = [0, 1]
    return features.reshape(-1, 2)


def test_a_planted_object_is_found():
    mask = discover(planted(8, [np.s_[2:6, 2:6]]), (8, 8), CutSettings(max_objects=1))[0]
    want = np.zeros((8, 8), bool)
    want[2:6, 2:6] = True
    assert np.array_equal(mask, want)


def test_all_parts_of_one_cut_are_kept():
    spots = [np.s_[3:8, c : c + 2] for c in (1, 5, 9)]
    assert [m.sum() for m in discover(planted(12, spots), (12, 12), CutSettings(all_components=True, max_objects=3))] == [10, 10, 10]


def test_masks_do_not_overlap_and_bad_features_are_errors():
    x = np.random.default_rng(8).normal(size=(144, 32))
    found = discover(x, (12, 12), CutSettings(max_objects=3))
    assert found and sum(m.astype(int) for m in found).max() == 1
    for bad, grid in [(np.zeros((5, 2)), (4, 4)), (np.full((16, 2), np.nan), (4, 4))]:
        try:
            discover(bad, grid)
            raise AssertionError
        except ValueError:
            pass


def test_splitting_keeps_every_cell_and_respects_limits():
    whole, halves = np.ones((8, 8), bool), np.zeros((8, 8, 2))
    halves[:, :4], halves[:, 4:] = [1, 0], [0.7, 0.7]
    parts = refine([whole], halves.reshape(64, 2), CutSettings(split_depth=2))
    assert [p.sum() for p in parts] == [32, 32] and (parts[0] | parts[1]).all()
    assert len(refine([whole], halves.reshape(64, 2), CutSettings(split_depth=2, max_instances=1))) == 1
    assert len(refine([whole], np.tile([1.0, 0.0], (64, 1)), CutSettings(split_depth=2))) == 1
    checker = np.eye(2)[np.indices((8, 8)).sum(axis=0) % 2].reshape(64, 2)
    assert len(refine([whole], checker, CutSettings(split_depth=2))) == 1


def test_largest_parts_first():
    mask = np.array([[1, 0, 1, 1], [0, 0, 0, 0], [1, 1, 1, 0]], bool)
    assert [m.sum() for m in sized_parts(mask, 2)] == [3, 2]


def test_the_cut_solves_the_generalized_problem():
    """(D - A) x = l D x, of the second smallest l."""
    x = np.random.default_rng(5).random((12, 12))
    a = x + x.T
    d = np.diag(a.sum(axis=1))
    v = relaxed_cut(a)
    left, right = (d - a) @ v, d @ v
    ratio = left @ v / (right @ v)
    assert np.allclose(left, ratio * right, atol=1e-9)
    assert np.isclose(ratio, np.sort(np.linalg.eigvals(np.linalg.inv(d) @ (d - a)).real)[1])


def test_thresholds_are_priced_as_their_cuts():
    """The halves taken are the cheapest of all deciles, priced one by one."""
    rng = np.random.default_rng(9)
    for _ in range(20):
        features = np.repeat(rng.normal(size=(2, 6)), 18, axis=0) + rng.normal(scale=0.15, size=(36, 6))
        s = CutSettings(split_depth=1, split_min_patches=2, split_max_ncut=1.5)
        got = halves(np.ones((6, 6), bool), features, s)
        unit = features / np.linalg.norm(features, axis=1, keepdims=True)
        w = np.maximum(np.exp((np.clip(unit @ unit.T, -1, 1) - 1) / s.split_temperature), s.epsilon)
        np.fill_diagonal(w, 0)
        v, best = relaxed_cut(w), None
        for q in range(1, 10):
            side = v > np.quantile(v, q / 10)
            if 2 <= side.sum() <= 34 and all(components(m.reshape(6, 6)).max() == 1 for m in (side, ~side)):
                between = w[side][:, ~side].sum()
                price = between / w[side].sum() + between / w[~side].sum()
                centre = [unit[m].mean(axis=0) for m in (side, ~side)]
                unlike = 1 - centre[0] @ centre[1] / np.prod([np.linalg.norm(c) for c in centre])
                if price < s.split_max_ncut and unlike >= s.split_min_cosine_distance and (best is None or price < best[0] - 1e-12):
                    best = price, side
        assert (got is None) == (best is None)
        if best:
            assert np.array_equal(got[0].ravel(), best[1])
