"""The queries of problems 3, 4, 6, 7, 8 and 9 over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import digest, encode, levels, overlap, packing, prn, tokens
from patchloom.session import cut, shared_path, table

PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _forward(spark: SparkSession, d: str) -> DataFrame:
    """Measured forward passes, each timing once: timing_id, model, day, value. Names of one model differ by case only."""
    t = table(spark, d, "timings").select(
        "timing_id", F.coalesce(F.lower(F.trim("model")), F.lit("")).alias("model"), F.to_date("taken_at").alias("day"), F.col("forward_ms").alias("value")
    )
    return digest.measured(t, "value").distinct()


def _estimates(digests: DataFrame, keys: list[str]) -> DataFrame:
    return cut(digest.estimate(digests, keys, PERCENTILES), "estimates")


def _forward_levels(spark: SparkSession, d: str) -> list[DataFrame]:
    """Percentiles of forward times by model and day, and by model over all days from the days' digests merged."""
    values = cut(_forward(spark, d), "forward")
    days = cut(digest.build(values, ["model", "day"], "value"), "days")
    levels = [(keys, _estimates(x, keys)) for keys, x in ((["model", "day"], days), (["model"], digest.merge(days, ["model"])))]
    return digest.certify(values, levels, "value", PERCENTILES)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """All of problem 3: metric, grp, day, p, value, n, rank_error, bound, within_bound.

    Forward times by model and day, the same by model over all days, and both benchmark metrics by stage (day null).
    """
    shape = lambda df, metric, grp, day: df.select(metric.alias("metric"), F.col(grp).alias("grp"), day.alias("day"), "p", "value", "n", "rank_error", "bound", "within_bound")
    none, forward = F.lit(None).cast("date"), F.lit("forward_ms")
    by_day, by_model = _forward_levels(spark, d)
    by_stage = shape(p3_bench(spark, d), F.col("metric"), "stage", none)
    return shape(by_day, forward, "model", F.col("day")).unionByName(shape(by_model, forward, "model", none)).unionByName(by_stage)


def p3_certified(spark: SparkSession, d: str) -> DataFrame:
    """What is certain of problem 3's results: their groups, sizes, and that each counted error is within its stated bound."""
    return p3_percentiles(spark, d).select("metric", "grp", "day", "p", "n", "within_bound")


def p3_forward_ms(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles by model and day, with the counted rank error of each."""
    return _forward_levels(spark, d)[0]


def p3_forward_ms_model(spark: SparkSession, d: str) -> DataFrame:
    """The same by model over all days."""
    return _forward_levels(spark, d)[1]


def p3_bench(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of throughput and mask time by stage."""
    bench, keys = cut(_bench(spark, d), "bench"), ["metric", "stage"]
    return digest.certify(bench, [(keys, _estimates(digest.build(bench, keys, "value"), keys))], "value", PERCENTILES)[0]


def _bench(spark: SparkSession, d: str) -> DataFrame:
    """metric, stage, value of throughput and mask time, over rows of status ok or null, each once.

    Rows of another status (failed, oom) stay out: their times are those of a job cut short.
    A throughput off from images over seconds by 60, 3,600 or 1/1,000 is brought back to images a second; a mask time
    under one millisecond was noted in seconds.
    """
    b = table(spark, d, "benchmark_runs").where(F.col("status").isNull() | (F.lower(F.trim("status")) == "ok"))
    b = b.select("bench_id", F.coalesce(F.lower(F.trim("stage")), F.lit("")).alias("stage"), "images_processed", "elapsed_seconds", "throughput_images_per_sec", "maskcut_ms_image").distinct()
    rate = F.try_divide(F.col("images_processed"), F.col("elapsed_seconds"))
    off = F.try_divide(F.col("throughput_images_per_sec"), rate)
    factor = F.coalesce(*[F.when((off > f * 0.9) & (off < f * 1.1), F.lit(1.0 / f)) for f in (60.0, 3600.0, 0.001, 1000.0)], F.lit(1.0))
    mask = F.col("maskcut_ms_image") * F.when(F.col("maskcut_ms_image") < 1.0, 1000.0).otherwise(1.0)
    both = F.array(
        F.struct(F.lit("throughput_images_per_sec").alias("metric"), (F.col("throughput_images_per_sec") * factor).alias("value")),
        F.struct(F.lit("maskcut_ms_image").alias("metric"), mask.alias("value")),
    )
    return digest.measured(b.select("stage", F.inline(both)), "value")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(overlap.Pictures(table(spark, d, "image_records"), table(spark, d, "provenance"), cut))


def p4_by_source(spark: SparkSession, d: str) -> DataFrame:
    digests = table(spark, d, "provenance")
    return overlap.report(overlap.Pictures(table(spark, d, "image_records"), digests, cut), digests, cut)


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    """config_id, relative: the sample of each configuration, of numbers given in two arrivals by batch."""
    records = table(spark, d, "image_records")
    store = prn.PermanentNumbers(spark, shared_path(spark, "numbers"))
    store.insert(records.where("batch_no < 5"), "relative", "batch_no")
    store.insert(records.where("batch_no >= 5 OR batch_no IS NULL"), "relative", "batch_no")
    return prn.select(store.read(), store.thresholds(table(spark, d, "pipeline_configs"), "config_id")).withColumnRenamed("id", "relative")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(cut(tokens.token_counts(table(spark, d, "documents")), "sizes"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packed(spark, d).where("n_pieces > 1 AND piece = 0").select("doc_id")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packed(spark, d)


def p8_use(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, against the least number that could hold all."""
    full = packed(spark, d).where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return full.agg(F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("n") / packing.CAPACITY).alias("least"), (F.sum("n") / (F.count(F.lit(1)) * packing.CAPACITY)).alias("share_used"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """How many shards place which share of their tokens by cost, the rest by least room."""
    shard = F.shiftright("container", 32).alias("shard")
    per = packed(spark, d).where("container IS NOT NULL").groupBy(shard).agg(F.max("cost_share").alias("cost_share"), F.sum("n_tokens").alias("n_tokens"))
    return per.groupBy("cost_share").agg(F.count(F.lit(1)).alias("n_shards"), F.sum("n_tokens").alias("n_tokens"))


BANDS = ["basic", "mid", "adv"]


def _levels(spark: SparkSession, d: str) -> DataFrame:
    rated = levels.training_rows(table(spark, d, "level_samples"), BANDS)
    return levels.levels(table(spark, d, "documents"), rated)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "band")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Bands of each source: documents and prose words."""
    source = table(spark, d, "documents").select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"))
    return _levels(spark, d).join(source, "doc_id").groupBy("source", "band").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_words").alias("n_words"))


QUERIES = {
    f.__name__: f
    for f in (p3_percentiles, p3_certified, p3_forward_ms, p3_forward_ms_model, p3_bench, p4_found, p4_by_source, p6_sample, p7_ids, p8_found, p8_packed, p8_use, p8_shares, p9_found, p9_profile)
}

_NAME_SQL = f"""
forms AS (
  SELECT image_id, CASE WHEN split_part(relative, '/', 1) = 'train2017' THEN 1 ELSE 2 END AS split,
    regexp_replace(regexp_replace(regexp_replace(lower(trim(replace(replace(regexp_extract(relative, '[^/]*$'), '%20', ' '), '+', ' '))), '{overlap.SUFFIX}', ''), '{overlap.BEFORE}', ''), '{overlap.AFTER}', '') AS name
  FROM (SELECT DISTINCT image_id, relative FROM image_records) WHERE split_part(relative, '/', 1) IN ('train2017', 'val2017', 'test2017')),
parts AS (
  SELECT image_id, split, regexp_replace(regexp_extract(name, '^(\\pL[\\pL _.+%-]*?)[ _.+-]*0*(\\d+)$', 1), '[^\\pL]', '', 'g') AS letters, regexp_extract(name, '^(\\pL[\\pL _.+%-]*?)[ _.+-]*0*(\\d+)$', 2) AS frame
  FROM forms),
by_name AS (
  SELECT a.image_id AS t, b.image_id AS e FROM parts a JOIN parts b ON a.frame = b.frame AND a.split = 1 AND b.split = 2
  WHERE a.letters <> '' AND b.letters <> '' AND damerau_levenshtein(a.letters, b.letters) <= 1),
digests AS (
  SELECT DISTINCT p.image_id, f.split, lower(CASE WHEN regexp_matches(h, '^[0-9a-fA-F]{{64}}$') THEN h WHEN regexp_matches(trim(sha256), '^[A-Za-z0-9+/]{{43}}=$') THEN hex(from_base64(trim(sha256))) END) AS digest
  FROM (SELECT *, regexp_replace(regexp_replace(trim(sha256), '(?i)^sha-?256[:=]', ''), '[: -]', '', 'g') AS h FROM provenance) p JOIN forms f USING (image_id)),
by_digest AS (SELECT a.image_id AS t, b.image_id AS e FROM digests a JOIN digests b ON a.digest = b.digest AND a.split = 1 AND b.split = 2)"""

_UNIFORM = "CAST(CAST('0x' || substr(sha256({}), 1, 13) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE)"

_BENCH_SQL = """b AS (SELECT DISTINCT bench_id, coalesce(lower(trim(stage)), '') AS grp, images_processed, elapsed_seconds, throughput_images_per_sec, maskcut_ms_image FROM benchmark_runs WHERE status IS NULL OR lower(trim(status)) = 'ok'),
bench AS (SELECT 'throughput_images_per_sec' AS metric, grp, throughput_images_per_sec AS v FROM b UNION ALL SELECT 'maskcut_ms_image', grp, maskcut_ms_image FROM b)"""

SQL = {
    "p3_certified": f"""WITH f AS (SELECT DISTINCT timing_id, coalesce(lower(trim(model)), '') AS grp, CAST(taken_at AS DATE) AS day, forward_ms AS v FROM timings), {_BENCH_SQL},
g AS (SELECT 'forward_ms' AS metric, grp, day, count(*) AS n FROM f WHERE v > 0 AND isfinite(v) GROUP BY grp, day UNION ALL SELECT 'forward_ms', grp, NULL, count(*) FROM f WHERE v > 0 AND isfinite(v) GROUP BY grp
  UNION ALL SELECT metric, grp, NULL, count(*) FROM bench WHERE v > 0 AND isfinite(v) GROUP BY metric, grp)
SELECT metric, grp, day, p, n, true AS within_bound FROM g, (SELECT CAST(unnest([{", ".join(map(str, PERCENTILES))}]) AS DOUBLE) AS p)""",
    "p4_found": f"WITH {_NAME_SQL} SELECT DISTINCT least(t, e) AS id_a, greatest(t, e) AS id_b FROM (SELECT * FROM by_name UNION ALL SELECT * FROM by_digest)",
    "p4_by_source": f"""WITH {_NAME_SQL}, pairs AS (SELECT DISTINCT t, e FROM (SELECT * FROM by_name UNION ALL SELECT * FROM by_digest)),
part AS (SELECT DISTINCT image_id AS e, split_part(relative, '/', 1) AS split FROM image_records WHERE split_part(relative, '/', 1) IN ('val2017', 'test2017')),
source AS (SELECT image_id AS e, min(lower(trim(source))) AS source FROM provenance GROUP BY image_id),
linked AS (SELECT e, count(*) AS n FROM pairs GROUP BY e)
SELECT split, coalesce(source, '') AS source, CAST(sum(n) AS BIGINT) AS n_pairs, count(*) AS n_images FROM linked JOIN part USING (e) LEFT JOIN source USING (e) GROUP BY 1, 2""",
    "p6_sample": f"""WITH n AS (SELECT DISTINCT relative, {_UNIFORM.format("'id:' || relative")} AS u FROM image_records WHERE relative IS NOT NULL),
l AS (SELECT config_id, {_UNIFORM.format("'start:' || CAST(coalesce(seed, 0) AS VARCHAR)")} AS s, max(sample_share) OVER (PARTITION BY coalesce(seed, 0) ORDER BY config_id) AS t FROM pipeline_configs)
SELECT config_id, relative FROM n JOIN l ON u - s + CASE WHEN u < s THEN 1 ELSE 0 END < t""",
}
