import io
import tarfile

import pytest

from patchloom.sources import transfer

DATA = bytes(range(256)) * 40


def server(data, etag="e", cut=None, log=None):
    def answer(offset, length):
        if log is not None:
            log.append((offset, length))
        body = data[offset:] if length is None else data[offset : offset + length]
        headers = {"etag": etag, "content-length": str(len(body))}
        if length is not None:
            headers["content-range"] = f"bytes {offset}-{offset + length - 1}/{len(data)}"
        sent = body if cut is None else body[:cut]
        return transfer.Answer(200 if length is None else 206, headers, iter([sent[:1000], sent[1000:]]))

    return answer


def test_a_transfer_goes_on_where_it_broke_off(tmp_path):
    path, log = tmp_path / "f.zip", []
    ok = lambda p: p.read_bytes() == DATA
    with pytest.raises(EOFError):
        transfer.resume(server(DATA, cut=3000), path, len(DATA), "e", ok)
    assert not path.exists() and (tmp_path / "f.zip.part").stat().st_size == 3000
    with pytest.raises(ValueError):
        transfer.resume(server(DATA, etag="new"), path, len(DATA), "e", ok)
    assert transfer.resume(server(DATA, log=log), path, len(DATA), "e", ok) and path.read_bytes() == DATA
    assert log == [(3000, len(DATA) - 3000)] and not transfer.resume(server(b""), path, len(DATA), "e", ok)
    path.write_bytes(DATA[:-1])
    assert transfer.resume(server(DATA), path, len(DATA), "e", ok), "of another size: fetched anew"
    (tmp_path / "g.part").write_bytes(DATA + b"x")
    with pytest.raises(ValueError, match="larger"):
        transfer.resume(server(DATA), tmp_path / "g", len(DATA), "e", ok)
    with pytest.raises(ValueError, match="not valid"):
        transfer.resume(server(DATA), tmp_path / "h", len(DATA), "e", lambda p: False)


def test_ranges_read_as_the_file():
    log = []
    f = transfer.Ranged(server(DATA, log=log), len(DATA), "e", ahead=512)
    for at, n in ((0, 10), (100, 50), (5000, 700), (5600, 100), (len(DATA) - 5, 50)):
        f.seek(at)
        assert f.read(n) == DATA[at : at + n]
    assert log == [(0, 512), (5000, 700), (len(DATA) - 5, 5)]
    with pytest.raises(ValueError):
        transfer.Ranged(server(DATA, etag="x"), len(DATA), "e").read(5)


def archive():
    outer, offsets = io.BytesIO(), {}
    with tarfile.open(fileobj=outer, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for g in ("n1", "n2", "n3"):
            inner = io.BytesIO()
            with tarfile.open(fileobj=inner, mode="w", format=tarfile.USTAR_FORMAT) as u:
                for i in range(0 if g == "n3" else 4):
                    info = tarfile.TarInfo(f"{g}_{i}.JPEG")
                    info.size = 600 + i
                    u.addfile(info, io.BytesIO(bytes([i]) * info.size))
            info = tarfile.TarInfo(f"{g}.tar")
            info.size = len(inner.getvalue())
            t.addfile(info, io.BytesIO(inner.getvalue()))
    with tarfile.open(fileobj=io.BytesIO(outer.getvalue())) as t:
        offsets = {m.name: (m.offset_data, m.size) for m in t.getmembers()}
    return outer.getvalue(), offsets


def test_groups_are_fetched_by_ranges(spark, tmp_path):
    data, at = archive()
    plan = spark.createDataFrame([("n1.tar", at["n1.tar"][0], at["n1.tar"][1]), ("n2.tar", at["n2.tar"][0], 512 * 3 + 700), ("n3.tar", *at["n3.tar"])], "name STRING, offset BIGINT, take_bytes BIGINT")
    get = lambda **k: {r["name"]: r for r in transfer.fetch_groups(plan, lambda: server(data), len(data), "e", str(tmp_path), **k).collect()}
    out = get()
    assert (out["n1.tar"]["images"], out["n1.tar"]["image_bytes"], out["n2.tar"]["images"], out["n3.tar"]["error"]) == (4, 2406, 1, "no whole image")
    assert sorted(p.name for p in tmp_path.rglob("*.JPEG")) == ["n1_0.JPEG", "n1_1.JPEG", "n1_2.JPEG", "n1_3.JPEG", "n2_0.JPEG"]
    assert (tmp_path / "n1/n1_2.JPEG").read_bytes() == b"\x02" * 602
    assert get(most=2)["n1.tar"]["images"] == 2 and get(most=2)["n2.tar"]["error"] == "1 of 2 images"
