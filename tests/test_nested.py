import json

from patchloom.operators.nested import FlatTables, box_of, decode, visit

PAYLOAD = {
    "kind": "benchmark",
    "runs": [None, {"stage": "smoke", "timing_seconds": {"dino_seconds": None}}, {"timing_seconds": {"dino_seconds": "5.5"}}, {"timing_seconds": None}, {}],
    "samples": {"image": "a.jpg", "grid": [2, 2], "boxes_xywh_normalized": [None, [0.1, 0.2, 0.3, 0.4], {"x": 1, "y": 2, "w": 3, "h": 4, "score": 0.5}, [1, 2, 3], {"x": 1}], "masks": 3},
    "models": {"m": {"samples": [None, {"boxes_xywh_normalized": None, "masks": [None, {"mask_id": 1, "area": 4, "children": [{"part": 0, "area": 1}]}]}]}, "n": None, "o": {"samples": 4}},
}


def flat(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, p, "clash") for i, p in rows], "report_id BIGINT, payload STRING, tag STRING")
    return FlatTables.write(df, str(tmp_path / "flat"))


def test_children_and_their_parents(spark, tmp_path):
    text = json.dumps(PAYLOAD)
    t = flat(spark, tmp_path, [(1, text), (1, text), (2, json.dumps(text)), (3, text[:-5]), (4, None), (5, ""), (6, "[1]"), (7, '"x"')])
    found = sorted(tuple(r) for r in t.children().collect())
    one = [("box", "", 0, 1), ("box", "", 0, 2), ("mask", "m", 1, 1), ("run", "", 2, 0)]
    assert found == [(i, *c) for i in (1, 2) for c in one]
    box = t.read("box").where("report_id = 1 AND child_ord = 2").collect()[0]
    assert (box["x"], box["h"], box["score"]) == (1.0, 4.0, 0.5)
    keys = {r["pk"] for r in t.emitted().collect()}
    assert all(r["parent_pk"] in keys for r in t.emitted().where("parent_pk IS NOT NULL").collect())
    assert t.read("part").count() == 2 and t.read("sample").where("report_id = 1 AND model = ''").collect()[0]["grid"] == [2, 2]


def test_encoded_any_number_of_times(spark, tmp_path):
    text = json.dumps({"runs": [{"timing_seconds": {"dino_seconds": 1}}]})
    for _ in range(7):
        text = json.dumps(text)
    assert flat(spark, tmp_path, [(1, text)]).children().count() == 1


def test_keys_differ_and_rows_of_one_id_are_one(spark, tmp_path):
    box = {"boxes_xywh_normalized": [[0.1, 0.2, 0.3, 0.4]]}
    text = json.dumps({"samples": box, "models": {"": {"samples": box}, "a/samples/0": {"samples": box}, "a": {"samples": box}}})
    t = flat(spark, tmp_path, [(5, text), (5, None), (None, text), (None, text + " "), (None, text)])
    assert len({r["parent_pk"] for r in t.read("box").where("report_id = 5").collect()}) == 4
    keys = [(r["tag"], r["pk"]) for r in t.emitted().collect()]
    assert len(keys) == len(set(keys)) == 3 * (1 + 3 + 4 + 4)


def test_empty(spark, tmp_path):
    assert flat(spark, tmp_path, []).children().count() == 0


def test_boxes_need_four_numbers():
    assert box_of([1, 2, 3, None]) is None and box_of([1, 2, 3, True]) is None and box_of([1, 2, 3, 4, 5]) is None
    assert box_of({"x": 0, "y": 0, "w": 0, "h": 0}) == {"x": 0, "y": 0, "w": 0, "h": 0}


def test_deep_and_long_payloads():
    assert decode("[" * 100_000) is None
    many = {"samples": [{"boxes_xywh_normalized": [[0, 0, 1, 1]] * 50_000}]}
    assert sum(r[0] == "box" for r in visit(1, json.dumps(many))) == 50_000


def test_numbers_in_quotes_are_read(spark, tmp_path):
    timings = [{"dino_seconds": v, "decode_seconds": 1} for v in ("51.51152", 2, 0.25, None, "n/a", "1d", True)]
    text = json.dumps({"runs": [{"images_processed": n, "timing_seconds": t} for n, t in zip(("12", 3, 12.5, None, "x", 1, 1), timings)]})
    rows = flat(spark, tmp_path, [(1, text)]).read("run").orderBy("parent_ord").collect()
    assert [r["dino_seconds"] for r in rows] == [51.51152, 2.0, 0.25, None, None, None, None]
    assert [r["images_processed"] for r in rows] == [12, 3, None, None, None, 1, 1] and all(r["decode_seconds"] == 1.0 for r in rows)


def test_parts_without_a_column_are_kept(spark, tmp_path):
    run = {"stage": "smoke", "errors": [{"image": "a", "error": "\ud800"}], "quality": {"n": 1}, "dino_seconds": 9, "timing_seconds": {"dino_seconds": 1, "bbox_seconds": 2}}
    sample = {"image": "a", "pca_explained_variance_ratio": [0.5], "boxes_xywh_normalized": [{"x": 1, "y": 1, "w": 1, "h": 1, "name": "b"}], "masks": [{"area": 4, "bbox": [1], "children": [{"part": 0, "more": [1]}]}]}
    root = {"kind": "k", "system": {"cpu": 8}, "warnings": ["w"], "runs": [run], "models": {"m": {"metadata": {"dim": 384}, "key_shape": [1], "samples": [sample]}, "odd": 4}}
    t = flat(spark, tmp_path, [(1, json.dumps(root))])
    rest = {tag: json.loads(t.read(tag).collect()[0]["rest"]) for tag in ("report", "run", "model", "sample", "box", "mask", "part")}
    assert rest["report"] == {"system": {"cpu": 8}, "warnings": ["w"], "models": {"odd": 4}}
    assert rest["run"] == {"errors": run["errors"], "quality": {"n": 1}, "dino_seconds": 9, "timing_seconds": {"bbox_seconds": 2}}
    assert rest["model"] == {"metadata": {"dim": 384}, "key_shape": [1]} and rest["sample"] == {"pca_explained_variance_ratio": [0.5]}
    assert (rest["box"], rest["mask"], rest["part"]) == ({"name": "b"}, {"bbox": [1]}, {"more": [1]})
    assert t.read("run").collect()[0]["dino_seconds"] == 1.0 and t.read("mask").collect()[0]["area"] == 4
