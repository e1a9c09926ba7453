import datetime
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchloom.operators import drift

SCHEMA = "file_id BIGINT, workspace STRING, written_at TIMESTAMP_NTZ, body STRING, fields STRING"


def files(spark, bodies, workspace="w"):
    start = datetime.datetime(2026, 1, 1)
    rows = [(i, workspace, start + datetime.timedelta(hours=i), b, "extra") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, SCHEMA)


def found(spark, bodies):
    return sorted(tuple(r) for r in drift.changes(drift.headers(files(spark, bodies))).collect())


def brute(bodies):
    """State kept file by file, as the definition has it."""
    out, state, first = [], {}, True
    for i, body in enumerate(bodies):
        fields = drift.read_header(body)
        if fields is None:
            continue
        now = {p: (k, v) for p, k, v in fields}
        if first:
            state, first = {p: s for p, s in now.items() if s[0]}, False
            continue
        parent = lambda p: p.rpartition(".")[0]
        added = {p: s for p, s in now.items() if s[0] and p not in state}
        gone = {p: s for p, s in state.items() if p not in now}
        out += [(i, p, "retyped") for p, s in now.items() if s[0] and p in state and state[p][0] != s[0]]
        used = set()
        for p in sorted(added):
            match = [g for g in sorted(gone) if g not in used and gone[g] == added[p] and parent(g) == parent(p)]
            used.update(match[:1])
            out.append((i, p, "renamed" if match else "added"))
        out += [(i, p, "removed") for p in gone if p not in used]
        state = {p: s for p, s in state.items() if p not in gone} | {p: s for p, s in now.items() if s[0]}
    return sorted(out)


def test_each_kind_of_change(spark):
    bodies = ['{"a": 1, "b": {"c": "x"}}', '{"a": 1.0, "b": {"d": "x"}, "e": [1]}', '{"a": null, "b": {"d": null}}']
    assert found(spark, bodies) == [(1, "a", "retyped"), (1, "b.d", "renamed"), (1, "e", "added"), (2, "e", "removed")]


def test_null_tells_nothing_and_torn_files_are_skipped(spark):
    bodies = ['{"a": 1}', '{"a": nu', None, "", "[1]", '{"a": null}', '{"a": "1"}', "{}", '{"a": null}', '{"a": 2}']
    assert found(spark, bodies) == [(6, "a", "retyped"), (7, "a", "removed"), (9, "a", "added")]


def test_repeated_rows_count_once_and_empty_input(spark):
    df = files(spark, ['{"a": 1}', '{"b": 2}'])
    assert drift.changes(drift.headers(df.union(df))).count() == 2
    assert drift.changes(drift.headers(df.limit(0))).count() == 0
    assert drift.unified(drift.headers(df.limit(0))).count() == 0


def test_unified_casts_to_the_least_upper_bound(spark):
    bodies = ['{"a": 1, "A": true, "s": {"t": [1, 2]}}', '{"a": 1.5, "A": false, "s": {"t": null}}', '{"a": "x"}']
    t = drift.unified(drift.headers(files(spark, bodies)))
    assert dict(t.dtypes)["s__t"] == "array<string>"
    assert len(set(c.lower() for c in t.columns)) == len(t.columns)
    kinds = {r["path"]: r["type"] for r in drift.fold_schemas(drift.headers(files(spark, bodies))).collect()}
    assert kinds == {"a": "string", "A": "boolean", "s.t": "array<string>"}
    assert t.count() == 3


def test_thousands_of_fields_are_all_columns(spark):
    wide = {f"f{i}": i for i in range(2100)}
    t = drift.unified(drift.headers(files(spark, [json.dumps(wide), '{"f7": 1.5}'])))
    assert len(t.columns) == 2103 and dict(t.dtypes)["f7"] == "double" and dict(t.dtypes)["f2099"] == "bigint"
    first, second = t.orderBy("file_id").collect()
    assert (first["f2099"], second["f7"], second["f2099"]) == (2099, 1.5, None)


def test_files_without_an_id_and_numbers_that_are_no_json(spark):
    df = files(spark, ['{"a": 1}', '{"b": 2}', '{"c": NaN}']).withColumn("file_id", F.lit(None).cast("bigint"))
    assert sorted(tuple(r) for r in drift.changes(drift.headers(df.union(df))).collect()) == [(None, "a", "removed"), (None, "b", "added")]


def test_a_rename_between_fields_of_other_union_types(spark):
    assert found(spark, ['{"a": 4, "x": 1}', '{"b": 4, "x": 1}', '{"a": 1.5, "x": 1}']) == [(1, "b", "renamed"), (2, "a", "added"), (2, "b", "removed")]


@pytest.mark.parametrize(("bits", "kind"), [(1, "boolean"), (2, "bigint"), (4, "double"), (6, "double"), (8, "string"), (16, "array<string>"), (3, "string"), (18, "string"), (0, "string")])
def test_lattice(spark, bits, kind):
    assert spark.range(1).select(drift.promoted(F.lit(bits)).alias("t")).collect()[0]["t"] == kind


values = st.sampled_from([None, 1, 2, 1.5, "x", True, [1]])
document = st.dictionaries(st.sampled_from(["a", "b", "c"]), st.one_of(values, st.dictionaries(st.sampled_from(["p", "q"]), values, max_size=2)), max_size=3)


@settings(max_examples=8, deadline=None)
@given(st.lists(document, min_size=1, max_size=8))
def test_windows_agree_with_brute_force(spark, documents):
    bodies = [json.dumps(x) for x in documents]
    assert found(spark, bodies) == brute(bodies)
