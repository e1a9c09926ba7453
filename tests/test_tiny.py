import json

import pytest

from patchloom.operators.compaction import Conflict, SnapshotTable
from patchloom.plans.problems import RECORDS
from patchloom.sources.tiny import read_tiny, records_of, whole

R = {"path": "/p/a b.jpg", "relative": "x//./a b.jpg", "size": "12", "mtime_ns": 1756882748098757255, "key": None}
ROW = ("x/a b.jpg", 12, 1756882748098757255, None, "/p/a b.jpg")


@pytest.mark.parametrize(
    ("value", "number"),
    [(5, 5), ("5", 5), (" 5 ", 5), ("5.0", 5), ("1.2e3", 1200), ("1,200", 1200), ("5.5", None), ("", None), (None, None), (True, None), ("x", None), (2**63, None), ("NaN", None), (float("inf"), None)],
)
def test_whole(value, number):
    assert whole(value) == number


def test_formats_agree():
    line = json.dumps(R)
    assert list(records_of("a.jsonl", f"﻿{line}\r\n\r\n{line}\n{line[:30]}")) == [ROW, ROW]
    assert list(records_of("a.JSON", json.dumps([R, 3, R]))) == [ROW, ROW]
    assert list(records_of("a.json", json.dumps(R)[:-1])) == []
    assert list(records_of("a.csv", '/p/a b.jpg,"x//./a b.jpg",12,1756882748098757255,\n')) == [ROW]
    assert list(records_of("a.tsv", "mtime_ns\tsize\trelative\tkey\tpath\r\n1756882748098757255\t12\tx/a b.jpg\t\t/p/a b.jpg\r\n")) == [ROW]


def test_torn_rows_are_none():
    whole_row = "x/a.jpg,12,1756882748098757255\n"
    assert len(list(records_of("a.csv", "relative,size,mtime_ns\n" + whole_row * 2))) == 2
    assert len(list(records_of("a.csv", "relative,size,mtime_ns\n" + whole_row + "x/b.jpg,12,17568"))) == 1
    assert len(list(records_of("a.csv", "relative,size,mtime_ns\n" + whole_row + '"x/b.jp'))) == 1
    assert list(records_of("a.csv", "relative,si")) == []
    assert [list(records_of(p, b)) for p, b in [("a.csv", ""), ("a.csv", None), (None, "x"), ("a.csv", "  "), ("a.json", "null"), ("a.xml", "<a/>")]] == [[]] * 6


def test_rows_after_a_broken_one_are_read():
    body = 'relative,size,mtime_ns\na.jpg,1,1\n"b".jpg,2,2\nc.jpg,3,3\nd.jpg,4,4\n'
    assert [r[0] for r in records_of("a.csv", body)] == ["a.jpg", "c.jpg", "d.jpg"]
    assert [r[0] for r in records_of("a.csv", body + '"e.jpg,5,5\nf.jpg,6,6\n')] == ["a.jpg", "c.jpg", "d.jpg", "f.jpg"]
    many = "relative,size,mtime_ns\n" + "".join(f'"{i}"x,1,1\n{i}.jpg,{i},1\n' for i in range(20_000))
    assert len(list(records_of("a.csv", many))) == 20_000, "in linear time"


def table_of(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "t"), RECORDS, "part")


def rows(spark, *rs):
    return spark.createDataFrame(list(rs), RECORDS)


ID = ["relative", "size", "mtime_ns"]


def test_compaction_keeps_each_record_once(spark, tmp_path):
    t = table_of(spark, tmp_path)
    assert t.compact(ID, 1, 1 << 20)["partitions"] == 0 and t.read().count() == 0
    for key in (None, "k", None):
        t.append(rows(spark, ("a", 1, 1, key, "p", 0), ("a", 1, 2, key, "p", 0), ("b", 1, 1, key, "p", 1)).coalesce(1))
    done = t.compact(ID, 1, 1 << 20)
    assert done == {"version": 4, "partitions": 2, "untouched": 0, "files_before": 6}
    assert sorted(tuple(r)[:4] for r in t.read().collect()) == [("a", 1, 1, "k"), ("a", 1, 2, "k"), ("b", 1, 1, "k")]
    assert {r["part"]: r["n_files"] for r in t.census(1 << 20).collect()} == {"0": 1, "1": 1}
    assert t.compact(ID, 1, 1 << 20)["partitions"] == 0
    t.append(rows(spark, ("b", 1, 1, None, "p", 1)).coalesce(1))
    assert t.compact(ID, 5, 1 << 20) | {"version": 0} == {"version": 0, "partitions": 1, "untouched": 1, "files_before": 2}, "it may hold a record twice"
    assert t.read().count() == 3


def test_only_partitions_of_too_many_small_files_are_rewritten(spark, tmp_path):
    t = table_of(spark, tmp_path)
    for i in range(4):  # partition 0 is delivered to four times, partition 1 once; one record again, in another order of fields
        delivered = [("a", i, 1, None, "p", 0), ("a", max(0, i - 1), 1, "k", "p", 0), ("a", i, 1, None, "q", 0)] + ([("b", 7, 1, None, "p", 1), ("n", 1, None, None, "p", None)] if i == 2 else [])
        t.append(rows(spark, *delivered).coalesce(1), ID)
    before = {r["path"] for r in t.files().collect()}
    assert {r["part"]: (r["n_files"], r["clean"]) for r in t.census(1 << 20).collect()} == {"0": (4, True), "1": (1, True), "__HIVE_DEFAULT_PARTITION__": (1, True)}
    assert t.compact(ID, 2, 1 << 20) == {"version": 5, "partitions": 1, "untouched": 2, "files_before": 4}
    live = {r["part"]: r["n_files"] for r in t.census(1 << 20).collect()}
    assert live == {"0": 1, "1": 1, "__HIVE_DEFAULT_PARTITION__": 1}
    assert {r["path"] for r in t.files().collect()} > before, "what other versions name is left as it is"
    assert sorted(r["size"] for r in t.read().where("part = 0").collect()) == [0, 1, 2, 3]
    assert [t.read(v).count() for v in range(1, 6)] == [1, 2, 5, 6, 6], "old versions can be read"
    assert t.append(rows(spark, ("n", 1, None, None, "p", None)), ID) == 6 and t.read().count() == 6, "nothing new"
    assert t.sweep() == 4 and t.read().count() == 6


def test_large_partitions_get_several_files(spark, tmp_path):
    t = table_of(spark, tmp_path)
    many = spark.range(20_000).selectExpr("uuid() relative", "id size", "id mtime_ns", "uuid() key", "uuid() path", "0 part")
    t.append(many.repartition(8))
    before = t.census(1).collect()[0]["n_bytes"]
    t.compact(ID, 1, before // 3)
    assert t.read().count() == 20_000
    assert 2 <= t.census(1).collect()[0]["n_files"] <= 5


def test_large_arrivals_are_compared_by_a_shuffle(spark, tmp_path):
    t = table_of(spark, tmp_path)
    many = lambda a, b: spark.range(a, b).selectExpr("cast(id as string) relative", "id size", "id mtime_ns", "null key", "'p' path", "cast(id % 3 as int) part")
    t.append(many(0, 70_000), ID)
    t.append(many(10_000, 75_000).union(many(10_000, 75_000)), ID)
    assert t.read().count() == t.read().distinct().count() == 75_000


def test_writers_conflict_only_where_they_touch(spark, tmp_path, monkeypatch):
    t = table_of(spark, tmp_path)
    t.append(rows(spark, ("a", 1, 1, None, "p", 0), ("b", 1, 1, None, "p", 1)))
    with pytest.raises(Conflict):
        t._commit(1, t.live(), "append")
    write = t._write

    def meanwhile(*added):
        def run(df):
            monkeypatch.setattr(t, "_write", write)
            table_of(spark, tmp_path).append(rows(spark, *added))
            return write(df)

        monkeypatch.setattr(t, "_write", run)

    meanwhile(("c", 1, 1, None, "p", 2))
    assert t.append(rows(spark, ("d", 1, 1, None, "p", 0))) == 3, "appends follow one another"
    t.compact(ID, 9, 1 << 20)
    t.append(rows(spark, ("e", 1, 1, None, "p", 0)))
    meanwhile(("f", 1, 1, None, "p", 2))
    assert t.compact(ID, 9, 1 << 20)["partitions"] == 1 and t.read().count() == 6, "another partition was written to"
    meanwhile(("g", 1, 1, None, "p", 2))
    with pytest.raises(Conflict):
        t.compact(ID, 9, 1 << 20)
    assert t.read().count() == 7, "nothing is lost"
    meanwhile(("h", 1, 1, None, "p", 2))
    with pytest.raises(Conflict):
        t.append(rows(spark, ("h", 1, 1, None, "p", 2)), ID)
    t.compact(ID, 9, 1 << 20)
    assert t.read().count() == 8


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path):
    t = table_of(spark, tmp_path)
    t.append(rows(spark, ("a", 1, 1, None, "p", 0)))
    t._write(rows(spark, ("b", 1, 1, None, "p", 0)))
    (tmp_path / "t/versions/2").write_text('{"kind": "app')
    assert t.version() == 1 and t.read().count() == 1
    with pytest.raises(Conflict):
        t._commit(2, t.live(), "compact")
    assert t.sweep() == 1
    t.append(rows(spark, ("b", 1, 1, None, "p", 0)))
    assert t.version() == 2 and t.read().count() == 2


def test_combining_keeps_every_record(spark):
    line = json.dumps(R)
    files = spark.createDataFrame([(i, "a.jsonl", f"{line}\n{line.replace('12', str(i))}\n", 1) for i in range(50)], "file_id INT, file_path STRING, body STRING, size INT").coalesce(2)
    full, few = read_tiny(files), read_tiny(files, combine=10)
    assert full.count() == 100 and few.count() < 100
    assert full.drop("file_id").distinct().count() == few.drop("file_id").distinct().count()
