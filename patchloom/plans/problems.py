"""The queries of problems 1, 2 and 5 over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.operators import drift
from patchloom.operators.compaction import SnapshotTable
from patchloom.operators.nested import FlatTables
from patchloom.session import cut, shared_path, table
from patchloom.sources.tiny import read_tiny

#: A file of the compacted table, in bytes.
TARGET_BYTES = 128 << 20


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(cut(drift.headers(table(spark, d, "config_files")), "headers"))


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(cut(drift.headers(table(spark, d, "config_files")), "headers"))


def p1_union_schema(spark: SparkSession, d: str) -> DataFrame:
    return drift.fold_schemas(drift.headers(table(spark, d, "config_files")).dropDuplicates(["file_id"]))


RECORDS = "relative STRING, size BIGINT, mtime_ns BIGINT, key STRING, path STRING, part INT"
IDENTITY = ["relative", "size", "mtime_ns"]
#: Partitions, so that a task that lands 128 MB of deliveries writes no files smaller than a megabyte, and how many small files one may hold.
MOST_PARTS, MAX_SMALL = 128, 4


def compacted(spark: SparkSession, d: str) -> SnapshotTable:
    """tiny_files landed as they come and compacted, first those that arrived within a day, then the late ones.

    The partition is a hash of the record, so equal records meet in one partition whatever file delivered them. The first
    deliveries land without a shuffle, a small file a task and partition; compaction finds the partitions that hold too
    many, or a record twice, and rewrites these. Of the late ones just the records that are new are added; compaction then
    leaves alone whatever partition still holds no more than MAX_SMALL small files.
    """
    files = table(spark, d, "tiny_files")
    parts = min(MOST_PARTS, max(4, spark.sparkContext.defaultParallelism))
    part = F.pmod(F.xxhash64(*IDENTITY), F.lit(parts)).cast("int")
    is_late = F.coalesce(F.col("loaded_at") - F.col("written_at") > F.expr("INTERVAL 1 DAY"), F.lit(False))
    landed = lambda rows: read_tiny(rows, combine=50_000).withColumn("part", part).drop("file_id")
    target = SnapshotTable(spark, shared_path(spark, "records"), RECORDS, "part")
    target.append(landed(files.where(~is_late)))
    target.compact(IDENTITY, MAX_SMALL, TARGET_BYTES)
    target.append(landed(files.where(is_late)), IDENTITY)
    target.compact(IDENTITY, MAX_SMALL, TARGET_BYTES)
    return target


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return compacted(spark, d).read().select(*IDENTITY)


def p2_census(spark: SparkSession, d: str) -> DataFrame:
    """What is certain of the compacted table: no partition holds too many small files, and no record occurs twice."""
    target = compacted(spark, d)
    over = target.census(TARGET_BYTES // 2).agg(F.count(F.when(F.col("n_small") > MAX_SMALL, 1)).alias("over_bound"), F.count(F.when(~F.col("clean"), 1)).alias("not_clean"))
    again = target.read().groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("repeated"))
    return over.join(again)  # a row each


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return FlatTables.write(table(spark, d, "report_payloads")).children()


def p5_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The typed box table with the image of its parent sample: the parent-child link at work."""
    flat = FlatTables.write(table(spark, d, "report_payloads"))
    sample = flat.read("sample").select(F.col("pk").alias("parent_pk"), "image")
    return flat.read("box").join(sample, "parent_pk").select("report_id", "pk", "parent_pk", "model", "image", "x", "y", "w", "h")


QUERIES = {f.__name__: f for f in (p1_found, p1_unified, p1_union_schema, p2_found, p2_census, p5_found, p5_boxes)}

_NUMBER = "json_type({0}) IN ('DOUBLE', 'UBIGINT', 'BIGINT')"

#: Fields of each valid configuration file: file_id, workspace, ord, next_id, path, kind, val.
_FIELDS = """v AS (SELECT DISTINCT file_id, workspace, written_at, CAST(body AS JSON) AS body FROM config_files WHERE json_valid(body)),
f AS (SELECT file_id, workspace, row_number() OVER w AS ord, lead(file_id) OVER w AS next_id, body FROM v WHERE json_type(body) = 'OBJECT' WINDOW w AS (PARTITION BY workspace ORDER BY written_at, file_id)),
t AS (SELECT f.file_id, workspace, ord, next_id, replace(substr(j.fullkey, 3), '"', '') AS path,
    CASE j.type WHEN 'BOOLEAN' THEN 'boolean' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'decimal' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' END AS kind,
    CASE WHEN j.type = 'DOUBLE' THEN CAST(CAST(j.value AS DOUBLE) AS VARCHAR) ELSE CAST(j.value AS VARCHAR) END AS val
  FROM f, json_tree(f.body) j WHERE j.type <> 'OBJECT' AND j.fullkey NOT LIKE '%[%')"""

_PARTS = f"""WITH d AS (SELECT DISTINCT report_id, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'VARCHAR' THEN json_extract_string(payload, '$') ELSE payload END END AS p FROM report_payloads),
j AS (SELECT report_id, CAST(p AS JSON) AS j FROM d WHERE p IS NOT NULL AND json_valid(p)),
r AS (SELECT report_id, j, unnest(range(CAST(json_array_length(j, '$.runs') AS BIGINT))) AS i FROM j WHERE json_type(j, '$.runs') = 'ARRAY'),
places AS (
  SELECT report_id, '' AS model, json_extract(j, '$.samples') AS s FROM j
  UNION ALL SELECT report_id, k, json_extract(j, '$.models."' || k || '".samples') FROM (SELECT report_id, j, unnest(json_keys(j, '$.models')) AS k FROM j WHERE json_type(j, '$.models') = 'OBJECT')),
lists AS (SELECT report_id, model, CASE json_type(s) WHEN 'ARRAY' THEN s WHEN 'OBJECT' THEN json_array(s) END AS s FROM places),
spots AS (SELECT report_id, model, s, unnest(range(CAST(json_array_length(s) AS BIGINT))) AS i FROM lists WHERE s IS NOT NULL),
samples AS (SELECT report_id, model, i, json_extract(s, '$[' || i || ']') AS x FROM spots),
b AS (SELECT report_id, model, i, x, unnest(range(CAST(json_array_length(x, '$.boxes_xywh_normalized') AS BIGINT))) AS c FROM samples WHERE json_type(x, '$.boxes_xywh_normalized') = 'ARRAY'),
boxes AS (SELECT report_id, model, i, c, json_extract(x, '$.boxes_xywh_normalized[' || c || ']') AS e FROM b),
m AS (SELECT report_id, model, i, x, unnest(range(CAST(json_array_length(x, '$.masks') AS BIGINT))) AS c FROM samples WHERE json_type(x, '$.masks') = 'ARRAY')"""

SQL = {
    "p2_found": r"""WITH f AS (SELECT DISTINCT file_id, lower(regexp_extract(file_path, '[^.]*$')) AS kind, ltrim(body, chr(65279)) AS body FROM tiny_files WHERE body <> '' AND file_path IS NOT NULL),
lines AS (SELECT unnest(regexp_split_to_array(body, '\r\n|\n|\r')) AS v FROM f WHERE kind = 'jsonl'),
valid AS (SELECT CASE WHEN json_valid(v) THEN CAST(v AS JSON) END AS v FROM lines UNION ALL SELECT CASE WHEN json_valid(body) THEN CAST(body AS JSON) END FROM f WHERE kind = 'json'),
objects AS (SELECT v FROM valid WHERE json_type(v) = 'OBJECT' UNION ALL SELECT unnest(from_json(v, '["JSON"]')) FROM valid WHERE json_type(v) = 'ARRAY'),
json_records AS (SELECT CASE WHEN json_type(v, '$.relative') = 'VARCHAR' THEN json_extract_string(v, '$.relative') END AS relative,
    CASE WHEN json_type(v, '$.size') NOT IN ('BOOLEAN', 'ARRAY', 'OBJECT') THEN json_extract_string(v, '$.size') END AS size,
    CASE WHEN json_type(v, '$.mtime_ns') NOT IN ('BOOLEAN', 'ARRAY', 'OBJECT') THEN json_extract_string(v, '$.mtime_ns') END AS mtime_ns FROM objects WHERE json_type(v) = 'OBJECT'),
tables AS (SELECT file_id, CASE kind WHEN 'csv' THEN replace(body, chr(9), ' ') ELSE replace(replace(body, ',', chr(1)), chr(9), ',') END AS body, kind FROM f WHERE kind IN ('csv', 'tsv')),
rows_ AS (SELECT file_id, kind, list_filter(regexp_extract_all(body, '([^\r\n]*)(\r\n|\n|\r)', 1), lambda x: x <> '' AND regexp_full_match(x, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*')) AS ls FROM tables),
cells AS (SELECT file_id, kind, list_transform(ls, lambda l: list_transform(regexp_extract_all(',' || l, ',("(?:[^"]|"")*"|[^",]*)', 1), lambda c: CASE WHEN left(c, 1) = '"' THEN replace(c[2:-2], '""', '"') ELSE c END)) AS rs FROM rows_ WHERE len(ls) > 0),
heads AS (SELECT *, list_transform(rs[1], lambda c: lower(trim(c))) AS h FROM cells),
named AS (SELECT kind, rs, list_has_all(['path', 'relative', 'size', 'mtime_ns', 'key'], h) AND list_contains(h, 'relative') AS has_head, CASE WHEN list_has_all(['path', 'relative', 'size', 'mtime_ns', 'key'], h) AND list_contains(h, 'relative') THEN h ELSE ['path', 'relative', 'size', 'mtime_ns', 'key'] END AS names FROM heads),
each AS (SELECT names, kind, unnest(CASE WHEN has_head THEN rs[2:] ELSE rs END) AS r FROM named),
row_records AS (SELECT replace(r[list_position(names, 'relative')], chr(1), ',') AS relative, replace(r[list_position(names, 'size')], chr(1), ',') AS size, replace(r[list_position(names, 'mtime_ns')], chr(1), ',') AS mtime_ns FROM each WHERE len(r) = len(names)),
told AS (SELECT relative, TRY_CAST(regexp_replace(trim(size), '[,_]', '', 'g') AS DECIMAL(38, 9)) AS size, TRY_CAST(regexp_replace(trim(mtime_ns), '[,_]', '', 'g') AS DECIMAL(38, 9)) AS mtime_ns FROM (SELECT * FROM json_records UNION ALL SELECT * FROM row_records))
SELECT DISTINCT CASE WHEN left(relative, 1) = '/' THEN '/' ELSE '' END || array_to_string(list_filter(string_split(relative, '/'), lambda x: x NOT IN ('', '.')), '/') AS relative, CAST(size AS BIGINT) AS size, CAST(mtime_ns AS BIGINT) AS mtime_ns
FROM told WHERE trim(relative) <> '' AND size = floor(size) AND mtime_ns = floor(mtime_ns)""",
    "p2_census": "SELECT CAST(0 AS BIGINT) AS over_bound, CAST(0 AS BIGINT) AS not_clean, CAST(0 AS BIGINT) AS repeated",
    "p1_union_schema": f"""WITH {_FIELDS}, b AS (SELECT path, CASE kind WHEN 'boolean' THEN 1 WHEN 'integer' THEN 2 WHEN 'decimal' THEN 4 WHEN 'string' THEN 8 WHEN 'array' THEN 16 ELSE 0 END AS b FROM t),
g AS (SELECT path, bit_or(b) AS kind_bits, count(*) AS n_files FROM b GROUP BY path)
SELECT path, kind_bits, CASE kind_bits WHEN 1 THEN 'boolean' WHEN 2 THEN 'bigint' WHEN 4 THEN 'double' WHEN 6 THEN 'double' WHEN 16 THEN 'array<string>' ELSE 'string' END AS type, n_files FROM g""",
    "p1_found": f"""WITH {_FIELDS},
x AS (SELECT *, ord - row_number() OVER p AS island, lead(ord) OVER p AS nxt, CASE WHEN kind IS NOT NULL THEN struct_pack(kind := kind, val := val) END AS said FROM t WINDOW p AS (PARTITION BY workspace, path ORDER BY ord)),
y AS (SELECT *, last_value(said IGNORE NULLS) OVER (PARTITION BY workspace, path, island ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM x),
z AS (SELECT *, coalesce(said, was) AS now FROM y),
e AS (
  SELECT file_id, workspace, ord AS spot, 'added' AS what, path, kind, val FROM z WHERE ord > 1 AND kind IS NOT NULL AND was IS NULL
  UNION ALL SELECT file_id, workspace, ord, 'retyped', path, kind, val FROM z WHERE kind IS NOT NULL AND was IS NOT NULL AND kind <> was.kind
  UNION ALL SELECT next_id, workspace, ord + 1, 'removed', path, now.kind, now.val FROM z WHERE next_id IS NOT NULL AND now IS NOT NULL AND (nxt IS NULL OR nxt > ord + 1)),
p AS (SELECT *, regexp_replace(path, '[^.]*$', '') AS parent FROM e),
r AS (SELECT *, count(CASE WHEN what = 'added' THEN 1 END) OVER w AS n_added, count(CASE WHEN what = 'removed' THEN 1 END) OVER w AS n_removed,
    row_number() OVER (PARTITION BY workspace, spot, parent, kind, val, what ORDER BY path) AS k FROM p WINDOW w AS (PARTITION BY workspace, spot, parent, kind, val))
SELECT file_id, path AS field, CASE WHEN what = 'added' AND k <= n_removed THEN 'renamed' ELSE what END AS change_kind FROM r WHERE NOT (what = 'removed' AND k <= n_added)""",
    "p5_found": f"""{_PARTS}
SELECT report_id, 'run' AS child, '' AS model, i AS parent_ord, CAST(0 AS BIGINT) AS child_ord FROM r WHERE json_type(j, '$.runs[' || i || '].timing_seconds.dino_seconds') <> 'NULL'
UNION ALL SELECT report_id, 'box', model, i, c FROM boxes WHERE (json_type(e) = 'ARRAY' AND json_array_length(e) = 4 AND {" AND ".join(_NUMBER.format(f"json_extract(e, '$[{k}]')") for k in range(4))})
  OR (json_type(e) = 'OBJECT' AND {" AND ".join(_NUMBER.format(f"json_extract(e, '$.{k}')") for k in "xywh")})
UNION ALL SELECT report_id, 'mask', model, i, c FROM m WHERE json_type(x, '$.masks[' || c || ']') = 'OBJECT'""",
    "p5_boxes": f"""{_PARTS},
k AS (SELECT report_id, model, i, c, e, report_id || CASE WHEN model = '' THEN '' ELSE '/models/' || replace(replace(model, '~', '~0'), '/', '~1') END || '/samples/' || i AS parent_pk FROM boxes
  WHERE (json_type(e) = 'ARRAY' AND json_array_length(e) = 4 AND {" AND ".join(_NUMBER.format(f"json_extract(e, '$[{k}]')") for k in range(4))})
     OR (json_type(e) = 'OBJECT' AND {" AND ".join(_NUMBER.format(f"json_extract(e, '$.{k}')") for k in "xywh")}))
SELECT k.report_id, parent_pk || '/boxes/' || c AS pk, parent_pk, k.model, json_extract_string(x, '$.image') AS image,
  {", ".join(f"CAST(CASE json_type(e) WHEN 'ARRAY' THEN json_extract(e, '$[{n}]') ELSE json_extract(e, '$.{c}') END AS DOUBLE) AS {c}" for n, c in enumerate("xywh"))}
FROM k JOIN samples ON samples.report_id = k.report_id AND samples.model = k.model AND samples.i = k.i""",
}
