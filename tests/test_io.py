import io
import json
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from patchloom import config
from patchloom.functions import scalars
from patchloom.sinks import files
from patchloom.sources import archives, images, manifests
from patchloom.streaming import rates


def png(width, height, rgb):
    raw = b"".join(b"\0" + bytes(rgb) * width for _ in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_decode_features_and_error_rows(spark, tmp_path):
    from patchloom.operators.catalog import scan

    (tmp_path / "a.png").write_bytes(png(6, 4, (10, 200, 30)))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    found = images.decoded(spark, str(tmp_path), scan(spark, str(tmp_path)))
    rows = {r["relative"]: r for r in found.collect()}
    assert rows["broken.png"]["error"] and (rows["a.png"]["width"], rows["a.png"]["height"]) == (6, 4)
    t = images.tensor(bytes(rows["a.png"]["data"]), 6, 4, 3, 16)
    assert np.allclose(t[0], (10 / 255 - images.MEAN[0]) / images.DEVIATION[0], atol=1e-5)
    out = images.features(found, lambda: images.HashBackbone((2, 2)), 16).collect()
    assert sum(r["error"] is None for r in out) == 4 and sum(r["error"] is not None for r in out) == 1


def test_only_the_records_files_are_opened(spark, tmp_path):
    from patchloom.operators.catalog import scan

    for i in range(7):
        folder = tmp_path / ("a b" if i % 2 else "x[1],{2}*")
        folder.mkdir(exist_ok=True)
        (folder / f"{i}?.png").write_bytes(png(6, 4, (i, 200, 30)))
    records = scan(spark, str(tmp_path)).collect()
    (tmp_path / "unread.png").mkdir()  # neither an image nor readable as one
    (tmp_path / "a b/3?.png").unlink()
    asked = spark.createDataFrame([r for r in records if r["relative"].split("/")[1][0] in "0123"], "path STRING, relative STRING, size BIGINT, mtime_ns BIGINT, key STRING")
    out = images.decoded(spark, str(tmp_path), asked, named=2)
    rows = {r["relative"].split("/")[1]: r for r in out.collect()}
    assert {k: r["error"] for k, r in rows.items()} == {"0?.png": None, "1?.png": None, "2?.png": None, "3?.png": "is gone"}
    assert all(bytes(rows[f"{i}?.png"]["data"])[2] == i for i in range(3))
    opened = {f.split("/")[-1] for f in out.inputFiles()}
    assert len(opened) == 3
    assert images.decoded(spark, str(tmp_path), asked.limit(0)).count() == 0
    (tmp_path / "unread.png").rmdir()
    whole = {(r["relative"], r["error"] is None) for r in images.decoded(spark, str(tmp_path), asked, most_named=0).collect()}
    assert whole == {(r["relative"], r["error"] is None) for r in rows.values()}


def test_resizing_weights():
    assert np.allclose(images._weights(8, 8), np.eye(8))
    for size, side in ((100, 16), (16, 100), (7, 3), (1, 5)):
        w = images._weights(size, side)
        assert w.shape == (side, size) and np.allclose(w.sum(axis=1), 1)
        centres = w @ (np.arange(size) + 0.5)
        inner = np.abs(np.arange(side) + 0.5 - side / 2) < side / 2 - 3 * max(1, side / size)
        assert np.allclose(centres[inner], ((np.arange(side) + 0.5) * size / side)[inner], atol=0.05 * max(1, size / side))
    ramp = np.repeat(np.arange(0, 240, 2, dtype=np.uint8)[None, :, None], 120, axis=0)
    t = images.tensor(ramp.tobytes(), 120, 120, 1, 40)
    red = t[0] * images.DEVIATION[0] + images.MEAN[0]
    assert np.allclose(red[5], red[30]) and np.allclose(np.diff(red[5] * 255)[4:-4], 6, atol=1.01), "rounded to bytes"
    flat = images.tensor(bytes([200, 100, 50]) * 77, 11, 7, 3, 32)
    assert np.allclose(flat[0] * images.DEVIATION[0] + images.MEAN[0], 50 / 255, atol=1e-6)


def test_voc(spark):
    xml = "<annotation><size><width>100</width><height>50</height></size>{}</annotation>"
    obj = "<object><name>{}</name><bndbox><xmin>{}</xmin><ymin>1</ymin><xmax>50</xmax><ymax>25</ymax></bndbox></object>"
    df = lambda body, w=100.0: spark.createDataFrame([("i", xml.format(body), w, 50.0)], "id STRING, xml STRING, width DOUBLE, height DOUBLE")
    got = manifests.parse_voc(df(obj.format("thing", 1) + obj.format("other", 1)), {"thing": "t"}).collect()
    assert [tuple(r) for r in got] == [("i", 0, "t", 0.25, 0.25, 0.5, 0.5)]
    with pytest.raises(Exception, match="no area"):
        manifests.parse_voc(df(obj.format("thing", 60)), {"thing": "t"}).collect()
    with pytest.raises(Exception, match="aspect"):
        manifests.parse_voc(df(obj.format("thing", 1), 300.0), {"thing": "t"}).collect()


def test_voc_plain_and_parsed_agree(spark):
    """plain annotations are read by columns, the others by the parser; each is parsed once at most and objects keep their own fields."""
    head, tail = "<annotation><size><width>100</width><height>50</height></size>", "</annotation>"
    obj = "<object><name>{0}</name><bndbox><xmin>{1}</xmin><ymin>1</ymin><xmax>50</xmax><ymax>25</ymax></bndbox></object>"
    two = obj.format("thing", 1) + obj.format("other", 1) + obj.format("thing", 11)
    more = two.replace("<object>", "<object id='1'>").replace("<bndbox>", "<part><name>thing</name><bndbox><xmin>9</xmin></bndbox></part><bndbox>")
    texts = {
        "plain": head + two + tail, "spaced": "\n " + (head + two + tail).replace("><", ">\n  <").replace(">\n  </name", "></name") + "\n", "declared": '<?xml version="1.0"?>' + head + more + tail,
        "noted": head + "<!-- <object/> -->" + two.replace("thing", "&#116;hing") + tail, "nameless": head + obj.format("thing", 1) + "<object/>" + obj.format("thing", 11) + tail,
        "none": head + tail, "null": None, "long": head + obj.format("thing", 1) * 20_000 + tail, "root": "<other>" + two + "</other>",
    }
    df = lambda texts: spark.createDataFrame([(k, x, 100.0, 50.0) for k, x in texts.items()], "id STRING, xml STRING, width DOUBLE, height DOUBLE").coalesce(1)
    got = manifests.parse_voc(df(texts), {"thing": "t"}).collect()
    both = [(0, "t", 0.25, 0.25, 0.5, 0.5), (2, "t", 0.3, 0.25, 0.4, 0.5)]
    for k in ("plain", "spaced", "declared", "noted", "nameless"):
        assert sorted(tuple(r)[1:] for r in got if r["id"] == k) == both, k
    assert sum(r["id"] == "long" for r in got) == 20_000 and {r["id"] for r in got} == {"plain", "spaced", "declared", "noted", "nameless", "long"}
    with pytest.raises(Exception, match="no area"):
        manifests.parse_voc(df({"a": head + obj.format("thing", "?") + tail}), {"thing": "t"}).collect()
    for bad in (head + two, (head + two + tail).replace("<height>50</height>", "")):
        with pytest.raises(Exception, match="ParseError|aspect"):
            manifests.parse_voc(df({"a": bad}), {"thing": "t"}).collect()
    plan = manifests.parse_voc(df(texts), {"thing": "t"})._jdf.queryExecution().optimizedPlan().toString()
    assert "xpath" not in plan and plan.count("MapInArrow") == 1


def test_manifest_selection_and_last_metrics(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"images": [{"id": "1", "class": "a", "role": "support"}, {"id": "2", "class": "b", "role": "query", "more": 1}]}, indent=1))
    m = manifests.manifest_images(spark, str(tmp_path / "m.json"))
    assert [(r["ord"], r["id"], r["class"]) for r in manifests.by_role(m, "query").collect()] == [(1, "2", "b")]
    (tmp_path / "s.txt").write_text("b.jpg\r\na.jpg\n")
    assert [tuple(r) for r in manifests.selection(spark, str(tmp_path / "s.txt")).collect()] == [(0, "b.jpg"), (1, "a.jpg")]
    (tmp_path / "r.csv").write_text("  epoch, loss \n1, 5\n10, 3\n2, 4\n")
    assert manifests.last_metrics(spark, str(tmp_path / "r.csv")) == {"epoch": "10", "loss": "3"}
    assert manifests.last_metrics(spark, str(tmp_path / "none.csv")) == {}


def test_tar_and_zip(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w", format=tarfile.USTAR_FORMAT) as t:
        for name, size in (("n1/x.jpg", 700), ("n1/y.jpg", 10), ("n1/z.jpg", 2000)):
            info = tarfile.TarInfo(name)
            info.size = size
            t.addfile(info, io.BytesIO(bytes(size)))
    df = spark.createDataFrame([(str(tmp_path / "a.tar"), "clash")], "path STRING, name STRING")
    with tarfile.open(tmp_path / "a.tar") as t:
        want = [(m.name, m.offset_data, m.size) for m in t.getmembers()]
    assert [tuple(r)[1:] for r in archives.index(df).collect()] == want
    assert [r["name"] for r in archives.extract_tar(df, most=2).collect()] == ["n1/x.jpg", "n1/y.jpg"]
    assert [r["name"] for r in archives.extract_tar(df, take_bytes=4000).collect()] == ["n1/x.jpg", "n1/y.jpg"], "the cut member is dropped"
    assert archives.extract_tar(df, take_bytes=600).collect()[0]["error"]
    for name, body in (("ok.zip", ["t/a.jpg", "t/b.jpg"]), ("bad.zip", ["../a.jpg"])):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n in body:
                z.writestr(n, n)
    zip_ = lambda name: spark.createDataFrame([(str(tmp_path / name),)], "path STRING")
    read = lambda name: sorted(archives.extract_zip(zip_(name), 2, tasks=2).collect(), key=lambda r: r["ord"])
    assert [(r["name"], bytes(r["content"])) for r in read("ok.zip")] == [("t/a.jpg", b"t/a.jpg"), ("t/b.jpg", b"t/b.jpg")] and read("bad.zip")[0]["error"] == "unsafe path"
    have = archives.extract_zip(zip_("ok.zip"), tasks=2)
    assert archives.extract_zip(zip_("ok.zip"), present=have, tasks=2).count() == 0
    broken = bytearray((tmp_path / "ok.zip").read_bytes())
    broken[broken.index(b"t/a.jpg", 40)] ^= 1  # a byte of the first member's content
    (tmp_path / "broken.zip").write_bytes(broken)
    assert [r["error"] is None for r in read("broken.zip")] == [False, True]
    assert archives.extract_zip(zip_("a.tar"), tasks=2).collect()[0]["error"] and archives.extract_zip(zip_("none.zip"), tasks=2).collect()[0]["error"]
    with tarfile.open(tmp_path / "outer.tar", "w", format=tarfile.USTAR_FORMAT) as t:
        for name in ("n1.tar", "n2.tar"):
            t.add(tmp_path / "a.tar", name)
    with open(tmp_path / "outer.tar", "r+b") as f:
        f.seek(3 << 30)  # larger than any single value may be; only headers and members are read
        f.write(b"\0")
    inner = archives.index(spark.createDataFrame([(str(tmp_path / "outer.tar"),)], "path STRING"))
    assert [r["name"] for r in inner.collect()] == ["n1.tar", "n2.tar"]
    found = archives.extract_tar(inner.withColumnRenamed("archive", "path"), most=2).collect()
    assert [(r["ord"], r["name"], len(r["content"])) for r in found] == [(0, "n1/x.jpg", 700), (1, "n1/y.jpg", 10)] * 2
    listed = spark.createDataFrame([("t/a.jpg", 7, zlib.crc32(b"t/a.jpg")), ("t/b.jpg", 7, 1)], "name STRING, size BIGINT, crc BIGINT")
    assert [r["name"] for r in archives.missing_members(listed, have).collect()] == ["t/b.jpg"]
    archives.check_range(206, {"content-range": "bytes 5-9/20", "etag": "e"}, 5, 5, "e")
    for status, header, tag in [(200, "bytes 5-9/20", "e"), (206, "bytes 4-9/20", "e"), (206, "bytes 5-9/20", "f")]:
        with pytest.raises(ValueError):
            archives.check_range(status, {"content-range": header, "etag": "e"}, 5, 5, tag)


def test_files_are_whole_or_old(spark, tmp_path, monkeypatch):
    path = tmp_path / "d/x.json"
    files.write_json(path, {"a": 1})
    files.write_json(path, {"a": 2})
    rename = files._rename_over
    monkeypatch.setattr(files, "_rename_over", lambda *_: (_ for _ in ()).throw(OSError))
    with pytest.raises(OSError):
        files.write_json(path, {"a": 3})
    monkeypatch.setattr(files, "_rename_over", rename)
    assert json.loads(path.read_text()) == {"a": 2} and [f.name for f in path.parent.iterdir() if not f.name.startswith(".")] == ["x.json"]
    with pytest.raises(ValueError):
        files.write_json(path, {"a": float("nan")})
    with files.exclusive(tmp_path / "lock"), pytest.raises(RuntimeError):
        with files.exclusive(tmp_path / "lock"):
            pass
    (tmp_path / "lock").write_text(f"{files.socket.gethostname()} 4194303999")
    with files.exclusive(tmp_path / "lock"):
        pass
    (tmp_path / "lock").write_text("another-host 1")
    with pytest.raises(RuntimeError), files.exclusive(tmp_path / "lock"):
        pass


def test_reports_labels_and_training_folder(spark, tmp_path):
    payload = {"kind": "benchmark", "run_id": "r", "status": "ok", "runs": [{"stage": "smoke", "timing_ms_per_image": {"decode": 2, "write": 3}}], "warnings": ["w"]}
    files.save_report(tmp_path, payload)
    assert pd.read_csv(tmp_path / "runs.csv")["io_ms_image"].tolist() == [5]
    assert "- w" in (tmp_path / "summary.md").read_text()
    labels, receipt = files.load_labels(spark, str(tmp_path / "l"))
    assert labels.count() == receipt.count() == 0
    rows = spark.createDataFrame([("a", "")], "image STRING, label STRING")
    r = spark.createDataFrame([(1, "f", "/d", "a", 1, 2, [3, 4], "s", 0)], files.RECEIPT)
    files.save_labels(rows, r, str(tmp_path / "l"))
    labels, receipt = files.load_labels(spark, str(tmp_path / "l"))
    assert labels.collect() == rows.collect() and receipt.collect() == r.collect()
    routed = spark.createDataFrame([("train", "/x/a.jpg"), ("val", "/x/b.jpg")], "split STRING, path STRING")
    files.training_folder(routed, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t/lists")).count() == 2 and "split=val" in (tmp_path / "t/data.yaml").read_text()
    found = spark.createDataFrame([("a", 0, "dog", 0.8, {"x": 0.5, "y": 0.5, "w": 0.1, "h": 0.1})], "image STRING, ord INT, label STRING, confidence DOUBLE, box STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>")
    files.save_predictions(found, spark.createDataFrame([("a",), ("b",)], "image STRING"), str(tmp_path / "p"))
    assert {r["image"]: r["n_boxes"] for r in spark.read.json(str(tmp_path / "p")).collect()} == {"a": 1, "b": 0}


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('[masks]\ntau = 0.2\n[benchmark]\nbatch_sizes = [4]\n')
    c = config.load(tmp_path / "c.toml")
    assert c.masks.tau == 0.2 and c.benchmark.batch_sizes == (4,)
    for raw in ({"x": {}}, {"masks": {"x": 1}}, {"masks": {"tau": 1}}, {"filtering": {"min_box_area": 0.99}}, {"features": {"resolution": 33}}, {"benchmark": {"batch_sizes": []}}):
        with pytest.raises(ValueError):
            config.parse(raw)
    for raw in ({"maskcut": {"crf": True}}, {"dino": {"model": "x"}}, {"masks": {"tau": "0.1"}}, {"masks": {"max_objects": True}}, {"train": {"run_name": "A b"}}, {"train": {"image_size": 650}}, {"benchmark": {"worker_counts": [0]}},
                {"masks": {"split_depth": 1, "max_objects": 30}}, {"masks": {"split_temperature": 0}}, {"pipeline": {"output_dir": "/etc"}}, {"masks": {"tau": float("nan")}}):
        with pytest.raises(ValueError):
            config.parse(raw)
    with pytest.raises(ValueError, match="epochs.*patience"):
        config.parse({"train": {"epochs": 0, "patience": -1}})
    assert config.parse({"maskcut": {"split_max_ncut": 0.2}}).masks.split_max_ncut == 0.2
    same = config.parse({"features": {"device": "cpu"}, "pipeline": {"decode_workers": 9}, "masks": {"max_instances": 30, "split_min_patches": 4}, "train": {"epochs": 3}})
    assert same.fingerprint("m") == config.parse({}).fingerprint("m")
    split = config.parse({"masks": {"split_depth": 1}}).fingerprint("m")
    assert split != config.parse({}).fingerprint("m") and split != config.parse({"masks": {"split_depth": 1, "split_max_ncut": 0.2}}).fingerprint("m")
    assert config.training_identity("a", {"x": 1, "y": 2}) == config.training_identity("a", {"y": 2, "x": 1}) != config.training_identity("b", {"x": 1, "y": 2})
    assert config.below(tmp_path, "a/b") == tmp_path.resolve() / "a/b"
    for bad in ("..", ".", "/etc"):
        with pytest.raises(ValueError):
            config.below(tmp_path, bad)
    with pytest.raises(ValueError):
        config.apart(tmp_path, tmp_path / "x")
    assert config.resume_state(False, None, "i") == "new" and config.resume_state(True, {"identity": "i", "complete": True}, "i") == "complete"
    for args in ((True, None, "i"), (True, {"identity": "j"}, "i")):
        with pytest.raises(ValueError):
            config.resume_state(*args)
    pauses, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return 5

    assert config.retry(flaky, (ConnectionError,), sleep=pauses.append) == 5 and pauses == [1.0, 2.0]
    with pytest.raises(KeyError):
        config.retry(lambda: {}[1], (ConnectionError,), sleep=pauses.append)


def test_scalars(spark):
    df = spark.createDataFrame([(0.0,), (3661.9,), (-5.0,), (360000.0,), (None,)], "s DOUBLE")
    assert [r[0] for r in df.select(scalars.clock(F.col("s"))).collect()] == ["00:00:00", "01:01:01", "00:00:00", "100:00:00", None]
    df = spark.createDataFrame([("a/b.tar.gz",), ("a.b/c",), ("x.JPEG",)], "p STRING")
    assert [r[0] for r in df.select(scalars.label_key(F.col("p"))).collect()] == ["a/b.tar.txt", "a.b/c.txt", "x.txt"]
    df = spark.createDataFrame([("bytes 1-5/9",), ("bytes */9",)], "h STRING")
    assert [tuple(r[0]) for r in df.select(scalars.content_range(F.col("h"))).collect()] == [(1, 5, 9), (None, None, None)]
    jpeg = b"\xff\xd8\xff\xd9"
    tag = b"Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0"
    turned = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tag) + 2) + tag + b"\xff\xd9"
    assert images.exif_orientation(jpeg) is None and images.exif_orientation(turned) == 6
    df = spark.createDataFrame([(jpeg,), (turned,), (b"\xff\xd8",)], "b BINARY")
    assert [r[0] for r in df.select(images.upright_jpeg("b")).collect()] == [True, False, False]


def test_fetch_only_what_is_not_there(tmp_path):
    import hashlib

    path, data = tmp_path / "f", b"weights"
    digest = hashlib.sha256(data).hexdigest()
    assert images.fetch_verified(str(path), digest, lambda: data, files.atomic_write)
    assert not images.fetch_verified(str(path), digest, lambda: 1 / 0, files.atomic_write)
    with pytest.raises(ValueError):
        images.fetch_verified(str(tmp_path / "g"), digest, lambda: b"other", files.atomic_write)


def test_one_process_fetches(spark, tmp_path):
    import hashlib

    digest = hashlib.sha256(b"weights").hexdigest()
    assert files.fetch_once(str(tmp_path / "w"), digest, lambda: b"weights") and not files.fetch_once(str(tmp_path / "w"), digest, lambda: b"")
    with files.exclusive(tmp_path / "w.lock"), pytest.raises(RuntimeError, match="in use"):
        files.fetch_once(str(tmp_path / "w"), digest, lambda: b"weights")


def test_streams(spark, tmp_path):
    rows = [(f"k{i % 2}", f"2026-01-01 00:{i:02d}:00") for i in range(10)]
    df = spark.createDataFrame(rows, "key STRING, t STRING").select("key", F.col("t").cast("timestamp").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    batch = {(r["key"], str(r["start"])): r["n"] for r in rates.windowed(df, "ts", ["key"]).collect()}
    q = rates.windowed(stream, "ts", ["key"]).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["key"], str(r["start"])): r["n"] for r in spark.table("w").collect()} == batch
    q = rates.progress(stream, "key", "ts").writeStream.format("memory").queryName("p").outputMode("update").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {r["key"]: (r["n"], r["last_us"] - r["first_us"]) for r in spark.table("p").collect()} == {"k0": (5, 480_000_000), "k1": (5, 480_000_000)}
