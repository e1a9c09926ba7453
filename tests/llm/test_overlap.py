import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.llm import overlap

KEEP = lambda df, label: df
HEX = "9a923a84d5b8a25f39aa0422537700df5e9fecc8013b68415ab9a8f14a6cb74e"


@pytest.mark.parametrize(
    "name",
    ["red_old_barn_000042.jpg", "RED_OLD_BARN_42.PNG", "RedOldBarn0042.webp", "red%20old%20barn%2042.tif", "red+old+barn+42.jpeg", "red-old-barn-42 (1).jpg", "Copy_of_red_old_barn_42.jpg",
     "copy of red.old.barn.42.bmp", "~red__old__barn__42.orig.jpg", "small_copy of red_old_barn_042_q85.jpg", "red_old_barn_42_640x480.JPG", "red_old_barn_42-1024px.png", "red_old_barn_42@2x.png",
     "red_old_barn_42 - Copy_resized.jpg", "red_old_barn_42 (2)_thumb.jpg"],
)
def test_one_name_has_one_form(spark, name):
    df = spark.createDataFrame([(f"train2017/a/{name}",)], "relative STRING")
    assert df.select(overlap.name_form(F.col("relative"))).collect()[0][0] == "redoldbarn:42"


def test_names_that_never_decide(spark):
    df = spark.createDataFrame([("train2017/000000001.jpg",), ("train2017/red.jpg",), ("train2017/",), (None,), ("",)], "relative STRING")
    assert all(r[0] is None for r in df.select(overlap.name_form(F.col("relative"))).collect())


def test_digests_however_written(spark):
    import base64

    written = [HEX, HEX.upper(), f"sha256:{HEX}", f"SHA-256={HEX.upper()}", f"  {HEX} ", ":".join(HEX[i : i + 2] for i in range(0, 64, 2)), base64.b64encode(bytes.fromhex(HEX)).decode()]
    df = spark.createDataFrame([(w,) for w in written], "d STRING")
    assert {r[0] for r in df.select(overlap.digest_form(F.col("d"))).collect()} == {HEX}
    df = spark.createDataFrame([(w,) for w in (None, "", "n/a", "pending", HEX[:-1], "AAAA", "a" * 44)], "d STRING")
    assert all(r[0] is None for r in df.select(overlap.digest_form(F.col("d"))).collect())


def slip(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    letters = sorted(set(a + b))
    near = {a, *(a[:i] + a[i + 1 :] for i in range(len(a))), *(a[:i] + c + a[i + k :] for i in range(len(a) + 1) for c in letters for k in (0, 1)), *(a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1))}
    return b in near


def test_one_slip(spark):
    words = ["harbor", "habror", "harbr", "harborx", "harbox", "hrabro", "bar", "rab", "ba", "", "aharbor"]
    df = spark.createDataFrame(list(itertools.product(words, words)), "a STRING, b STRING")
    for r in df.withColumn("ok", overlap.one_slip(F.col("a"), F.col("b"))).collect():
        assert r["ok"] == slip(r["a"], r["b"]), tuple(r)


def test_no_pair_of_forms_is_missed(spark):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 24))) for _ in range(60)]
    forms = set()
    for i, w in enumerate(base):
        forms.add((f"{w}:{i % 3}", 1))
        k = int(rng.integers(0, len(w)))
        forms.add((f"{w[:k] + w[k + 1 :]}:{i % 3}" if len(w) > 2 else f"{w}q:{i % 3}", 2))
        forms.add((f"{w[:k]}z{w[k + 1 :]}:{i % 3}", 2))
        if k + 1 < len(w):
            forms.add((f"{w[:k]}{w[k + 1]}{w[k]}{w[k + 2 :]}:{i % 3}", 2))
    merged = {}
    for f, s in forms:
        merged[f] = merged.get(f, 0) | s
    df = spark.createDataFrame([(f, s & 1, s >> 1) for f, s in merged.items()], "form STRING, n_train INT, n_eval INT")
    found = {tuple(r) for r in overlap.form_pairs(df).collect()}
    cut = lambda f: f.rsplit(":", 1)
    want = {(a, b) for a, s in merged.items() for b, t in merged.items() if s & 1 and t & 2 and cut(a)[1] == cut(b)[1] and slip(cut(a)[0], cut(b)[0])}
    assert found == want


def test_short_slips_are_similar_enough(spark):
    pairs = [("ab:7", "ba:7"), ("a:8", "b:8"), ("abcd:9", "abdc:9"), ("a:1", "ab:1"), ("aa:2", "a:2")]
    df = spark.createDataFrame([(f, int(k == 0), k) for x in pairs for k, f in enumerate(x)], "form STRING, n_train INT, n_eval INT")
    assert {tuple(r) for r in overlap.form_pairs(df).collect()} == set(pairs)


def test_recall_of_minwise_hashes_alone(spark):
    """What the banded hashes find without the exact buckets, by length: all of long names, not of short ones."""
    rng = np.random.default_rng(11)
    for length, least in ((6, 0.75), (10, 0.97), (16, 0.99), (24, 0.999)):
        rows = []
        for i in range(400):
            w = "".join(rng.choice(list("abcdefghijklmnopqrst"), length))
            k = int(rng.integers(0, length - 1))
            other = [f"{w[:k]}z{w[k + 1 :]}", f"{w[:k]}{w[k + 1 :]}", f"{w[:k]}{w[k + 1]}{w[k]}{w[k + 2 :]}"][i % 3]
            rows += [(f"{w}:{i}", 1, 0), (f"{other}:{i}", 0, 1)] if other != w else []
        df = spark.createDataFrame(rows, "form STRING, n_train INT, n_eval INT")
        found = overlap.form_pairs(df, exact=0).count() / (len(rows) / 2)
        print(f"{length} letters: {found:.4f}")
        assert found >= least and overlap.form_pairs(df).count() == len(rows) / 2


IMAGES = "image_id BIGINT, relative STRING, source STRING"
DIGESTS = "image_id BIGINT, sha256 STRING, source STRING, relative STRING"


def test_pairs_of_splits_and_their_report(spark):
    rows = [
        (1, "train2017/a/red_old_barn_01.jpg"), (1, "train2017/a/red_old_barn_01.jpg"), (2, "val2017/RedOldBran1.png"), (3, "test2017/red_old_barn_2.jpg"), (4, "val2017/000000001.jpg"),
        (5, "train2017/000000001.jpg"), (6, "unlabeled2017/red_old_barn_01.jpg"), (7, "test2017/x.jpg"), (8, "train2017/new_old_barn_01.jpg"), (None, "val2017/red_old_barn_01.jpg"), (9, None),
        (10, "val2017/red_old_barn_01 (1).jpg"),
    ]
    images = spark.createDataFrame([(*r, "clash") for r in rows], IMAGES)
    digests = spark.createDataFrame([(5, HEX, " Field ", "x"), (7, HEX.upper(), "LAB", "x"), (7, "pending", None, "x"), (4, None, "lab", "x"), (2, "n/a", None, "x"), (6, HEX, "lab", "x"), (99, HEX, "lab", "x")], DIGESTS)
    p = overlap.Pictures(images, digests, KEEP)
    pairs = overlap.overlaps(p)
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, 2), (1, 10), (5, 7)]
    out = {(r["split"], r["source"]): (r["n_pairs"], r["n_images"]) for r in overlap.report(p, digests, KEEP).collect()}
    assert out == {("val2017", ""): (2, 2), ("test2017", "lab"): (1, 1)}


def test_copies_meet_all_partners(spark):
    """A third of all images are copies of one name and digest; still all pairs and no other come out."""
    rows = [(i, f"{'train2017' if i % 3 else 'val2017'}/d{i}/big_red_dog_7.jpg", "") for i in range(60)] + [(100 + i, f"train2017/w{i}_cat_sun_{i}.jpg", "") for i in range(120)]
    images = spark.createDataFrame(rows, IMAGES)
    digests = spark.createDataFrame([(i, HEX, "s", "r") for i in range(60)], DIGESTS)
    assert overlap.overlaps(overlap.Pictures(images, digests, KEEP)).count() == 20 * 40


def test_counts_are_those_of_the_pairs(spark):
    """Images of several names and digests, in both splits, in hot groups: counts by class agree with the pairs expanded."""
    rng = np.random.default_rng(8)
    names = ["red_dog", "rad_dog", "red_dgo", "blue_cat", "bluecat", "ab", "ba"]
    parts = ["train2017", "train2017", "val2017", "test2017"]
    rows = [(int(rng.integers(0, 60)), f"{parts[rng.integers(4)]}/{names[rng.integers(7)]}_{rng.integers(1, 3)}.jpg", "") for _ in range(140)]
    images = spark.createDataFrame(rows, IMAGES)
    digests = spark.createDataFrame([(int(rng.integers(0, 60)), f"{rng.integers(0, 12):064x}", ["A", "b "][rng.integers(2)], "r") for _ in range(60)], DIGESTS)
    p = overlap.Pictures(images, digests, KEEP)
    pairs = {tuple(r) for r in overlap.overlaps(p).collect()}
    split_of, source_of = {}, {}
    for i, r, _ in rows:
        split_of.setdefault(i, set()).add(r.split("/")[0])
    for r in digests.collect():
        source_of[r["image_id"]] = min(source_of.get(r["image_id"], "~"), r["source"].strip().lower())
    want: dict = {}
    partner: dict = {}
    joined = {(t, e) for i, j in pairs for t, e in ((i, j), (j, i))}
    direct = overlap.expanded(p.names, p.named, p.forms).unionByName(overlap.expanded(p.sums.selectExpr("key AS a", "key AS b"), p.marked, p.sums))
    directed = {tuple(r) for r in direct.where("t <> e").collect()}
    assert {(min(x), max(x)) for x in directed} == pairs and directed <= joined
    for _, e in directed:
        partner[e] = partner.get(e, 0) + 1
    for e, n in partner.items():
        for s in split_of[e] - {"train2017"}:
            a, b = want.get((s, source_of.get(e, "")), (0, 0))
            want[s, source_of.get(e, "")] = a + n, b + 1
    assert {(r["split"], r["source"]): (r["n_pairs"], r["n_images"]) for r in overlap.report(p, digests, KEEP).collect()} == want
    for block in (1, 2, 5):
        assert {tuple(r) for r in overlap.expanded(p.names, p.named, p.forms, block).collect()} == {tuple(r) for r in overlap.expanded(p.names, p.named, p.forms).collect()}


def test_empty(spark):
    pairs = overlap.overlaps(overlap.Pictures(spark.createDataFrame([], IMAGES), spark.createDataFrame([], DIGESTS), KEEP))
    assert pairs.count() == 0 and pairs.columns == ["id_a", "id_b"]
