"""Same or near-same pictures across splits: digests however written, file names but for spelling, marks and one letter.

Names are brought to one form, letters and frame number. Distinct forms get minwise hashes of their letter shingles (pairs
of neighbouring letters), banded; a bucket is a band's hashes and the frame number. Only candidates of a training and an
evaluation form meet. Candidates are verified: exact Jaccard similarity of the shingles, then at most one mistyped letter
(one changed, missing, added, or two neighbours swapped). Copies of one form or digest are one row until confirmed pairs
are expanded, so nothing is compared within a group of copies.

With BANDS = 18 of 2 hashes, a pair of SHORT letters and two swapped neighbours (Jaccard 0.62 at the least) is missed
with probability 4e-4, one of 20 letters (0.75) with 4e-7, one of 20 letters and one changed letter (0.82) with 1e-9. Of
fewer letters a slip changes most shingles, so forms of up to SHORT letters are also bucketed with each letter left out:
two words one slip apart share such a bucket, which makes their search exact.

Defined results. A null identifier or path is no picture; a missing digest (null, empty, a word in its place) equals no
other; names of digits only, or without a frame number, never decide. Repeated rows count once. Images of neither split
are not compared. Empty input gives empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from patchloom.session import join_small

BANDS, ROWS, SHORT = 18, 2, 10
#: Images of one key that meet as many of another in one task.
BLOCK = 2000
TRAIN, EVAL = 1, 2
_MIX = np.random.default_rng(7).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)

#: Suffixes of image files, and what marks a name as a copy or rendition, before or after it.
SUFFIX = r"\.(jpe?g|png|webp|bmp|tiff?|gif|heic|avif|jp2|ppm)$"
BEFORE = r"^(~|copy([ _-]\d+)?[ _-]of[ _-]|copy[ _-]|(small|large|medium|thumb|thumbnail|preview|resized|scaled|dup|edited|orig|original)[ _.-]|[ _.-])+"
AFTER = (
    r"([ _.-]*\(\d{1,3}\)|[ _.-]+(copy|dup|duplicate|thumb|thumbnail|small|large|medium|preview|resized|scaled|edited|edit|orig|original|final|web|lowres|hires)([ _-]?\d{1,2})?"
    r"|[ _.-]+q\d{1,3}|[ _.-]+\d{2,5}x\d{2,5}|[ _.-]+\d{2,5}(px|w|h)|@\dx|[ _.-]+)+$"
)


def split_of(relative: Column, train: tuple[str, ...], evaluation: tuple[str, ...]) -> Column:
    """TRAIN, EVAL or 0 by the first part of the path."""
    part = F.split_part(relative, F.lit("/"), F.lit(1))
    return F.when(part.isin(*train), TRAIN).when(part.isin(*evaluation), EVAL).otherwise(0)


def name_form(relative: Column) -> Column:
    """`letters:frame` of a file name, or null where the name doesn't decide."""
    name = F.regexp_replace(F.substring_index(relative, "/", -1), "%20|[+]", " ")
    name = F.regexp_replace(F.lower(F.trim(name)), SUFFIX, "")
    name = F.regexp_replace(F.regexp_replace(name, BEFORE, ""), AFTER, "")
    parts = r"^([\p{L}][\p{L} _.+%-]*?)[ _.+-]*0*(\d+)$"
    letters = F.regexp_replace(F.regexp_extract(name, parts, 1), r"[^\p{L}]", "")
    return F.when(letters != "", F.concat_ws(":", letters, F.regexp_extract(name, parts, 2)))


def digest_form(digest: Column) -> Column:
    """64 lower-case hex digits, or null for what is no SHA-256: hex with prefix, colons, blanks or capitals, and base64."""
    text = F.trim(digest)
    hexed = F.lower(F.regexp_replace(F.regexp_replace(text, r"(?i)^(sha-?256\s*[:=]\s*|0x)", ""), r"[\s:-]", ""))
    plain = F.regexp_replace(text, r"(?i)^sha-?256\s*[-:=]\s*", "")
    decoded = F.lower(F.hex(F.try_to_binary(F.translate(plain, "-_", "+/"), F.lit("base64"))))
    return F.when(hexed.rlike("^[0-9a-f]{64}$"), hexed).when(plain.rlike("^[A-Za-z0-9+/_-]{43}=?$") & (F.length(decoded) == 64), decoded)


def buckets(forms: DataFrame, bands: int = BANDS, exact: int = SHORT) -> DataFrame:
    """bucket, form: of each form its banded buckets, and of those of up to `exact` letters also the buckets of left-out letters."""
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("form", T.StringType())])
    arrow = to_arrow_schema(schema)

    def hashed(texts: list[str]) -> np.ndarray:
        import xxhash

        return np.fromiter((xxhash.xxh64_intdigest(x) for x in texts), np.uint64, len(texts))

    def run(batches):
        for batch in batches:
            forms = batch.column(0).to_pylist()
            if not forms:
                continue
            letters, frames = zip(*(f.rsplit(":", 1) for f in forms))
            padded = [f"^{x}$" for x in letters]
            sizes = np.array([len(x) for x in padded])
            points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
            ends = np.cumsum(sizes)
            inner = np.delete(np.arange(len(points)), ends - 1)  # a pair starts at each letter but a name's last
            pairs = (points[inner] << np.uint64(21)) ^ points[inner + 1]
            starts = np.r_[0, np.cumsum(sizes - 1)[:-1]]
            frame = hashed(list(frames))
            for band in range(bands):
                key = frame + np.uint64(band)
                for a, b in _MIX[:, band * ROWS : (band + 1) * ROWS].T:
                    h = pairs * a + b
                    h ^= h >> np.uint64(29)
                    h *= np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(32)
                    key = key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h, starts)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], schema=arrow)
            keys, names = [], []
            for i, x in enumerate(letters):
                if len(x) <= exact:
                    left_out = {x, *(x[:k] + x[k + 1 :] for k in range(len(x)))}
                    keys += [f"{y}:{frames[i]}" for y in left_out]
                    names += [forms[i]] * len(left_out)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(hashed(keys).view(np.int64)), pa.array(names)], schema=arrow)

    return forms.select("form").mapInArrow(run, schema)


def letter_pairs(word: Column) -> Column:
    """The set of pairs of neighbouring letters of a padded word."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(F.concat(F.lit("^"), word, F.lit("$")), i, F.lit(2))))


def similar(a: Column, b: Column) -> Column:
    """The exact Jaccard similarity of two sets of letter pairs is at least (n - 3) / (n + 3), n being the size of the first.

    A slip changes at most three pairs (a swap of neighbours), so words one slip apart are never less similar than that.
    """
    n, shared = F.size(a), F.size(F.array_intersect(a, b))
    return shared * (n + 3) >= (n + F.size(b) - shared) * (n - 3)


def one_slip(a: Column, b: Column) -> Column:
    """At most one letter changed, missing or added, or two neighbours swapped."""
    distance = F.levenshtein(a, b, 2)
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - 1)),
        lambda i: b == F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))),
    )
    return F.when(distance < 0, False).when(distance <= 1, True).when(F.length(a) != F.length(b), False).otherwise(swapped)


def form_pairs(forms: DataFrame, bands: int = BANDS, exact: int = SHORT) -> DataFrame:
    """a, b: confirmed pairs of a training and an evaluation form. `forms`: form, n_train, n_eval, one row a form."""
    left = buckets(forms.where("n_train > 0"), bands, exact).select("bucket", F.col("form").alias("a"))
    right = buckets(forms.where("n_eval > 0"), bands, exact).select("bucket", F.col("form").alias("b"))
    letters = lambda c: F.substring_index(c, ":", 1)
    frame = lambda c: F.substring_index(c, ":", -1)
    met = left.join(right, "bucket").where((F.col("a") != F.col("b")) & (frame("a") == frame("b"))).select("a", "b").distinct()
    likely = met.where(similar(letter_pairs(letters("a")), letter_pairs(letters("b"))))
    confirmed = likely.where(one_slip(letters("a"), letters("b")))
    same = forms.where("n_train > 0 AND n_eval > 0").select(F.col("form").alias("a"), F.col("form").alias("b"))
    return confirmed.unionByName(same)


def expanded(pairs: DataFrame, rows: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """t, e: the images of paired keys. `pairs`: a, b; `rows`: key, split, image_id; `sizes`: key, n_train, n_eval.

    Pairs of keys that few images hold are joined as they are. Of the others both sides are cut into blocks of about
    `block` images by hash, and each block of one side meets each of the other in a task of its own.
    """
    n = sizes.select("key", "n_train", "n_eval")
    sized = pairs.join(n.select(F.col("key").alias("a"), "n_train"), "a").join(n.select(F.col("key").alias("b"), "n_eval"), "b")
    hot_key = (F.col("n_train") > block * 50) | (F.col("n_eval") > block * 50)
    side = lambda df, split, key, name: df.where(F.col("split") == split).select(F.col("key").alias(key), F.col("image_id").alias(name))
    most = n.agg(F.max("n_train").alias("t"), F.max("n_eval").alias("e")).head()
    if (most["t"] or 0) * (most["e"] or 0) <= block * block and max(most["t"] or 0, most["e"] or 0) <= block * 50:
        return pairs.join(side(rows, TRAIN, "a", "t"), "a").join(side(rows, EVAL, "b", "e"), "b").select("t", "e")
    is_hot = hot_key | (F.col("n_train") * F.col("n_eval") > block * block)
    cool_rows = rows.join(n.where(hot_key).select("key"), "key", "left_anti")  # pairs of a hot key are all hot
    cool = sized.where(~is_hot).select("a", "b").join(side(cool_rows, TRAIN, "a", "t"), "a").join(side(cool_rows, EVAL, "b", "e"), "b").select("t", "e")
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    hot = sized.where(is_hot).select("a", "b", blocks("n_train").alias("ts"), blocks("n_eval").alias("es"))
    each = lambda df, count, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(count) - 1)))

    def dealt(split: int, key: str, name: str, count: str, slot: str) -> DataFrame:
        """The images of hot pairs with the number of their block, once for each pair."""
        known = hot.select(F.col(key), count).distinct()
        mine = join_small(side(rows, split, key, name), known, [key]).withColumn(slot, F.pmod(F.xxhash64(name), F.col(count)).cast("int")).drop(count)
        return each(hot, count, slot).join(mine, [key, slot])

    train, evals = each(dealt(TRAIN, "a", "t", "ts", "_t"), "es", "_e"), each(dealt(EVAL, "b", "e", "es", "_e"), "ts", "_t")
    met = train.select("a", "b", "_t", "_e", "t").join(evals.select("a", "b", "_t", "_e", "e"), ["a", "b", "_t", "_e"])
    return cool.unionByName(met.select("t", "e"))


def _sizes(rows: DataFrame) -> DataFrame:
    count = lambda split: F.count(F.when(F.col("split") == split, 1))
    return rows.groupBy("key").agg(count(TRAIN).alias("n_train"), count(EVAL).alias("n_eval"))


class Pictures:
    """The keys of pictures, their sizes, and the confirmed pairs of keys: what both pairs and counts are made of."""

    def __init__(self, images: DataFrame, digests: DataFrame, cut, train: tuple[str, ...] = ("train2017",), evaluation: tuple[str, ...] = ("val2017", "test2017")):
        """`images`: image_id, relative; `digests`: image_id, sha256, source; other columns are ignored. `cut` stores an intermediate."""
        part = F.split_part("relative", F.lit("/"), F.lit(1)).alias("part")
        known = images.select("image_id", part, split_of(F.col("relative"), train, evaluation).alias("split"), name_form(F.col("relative")).alias("form"))
        self.known = cut(known.where("split > 0 AND image_id IS NOT NULL").distinct(), "pictures")
        self.named = self.known.where("form IS NOT NULL").select("image_id", "split", F.col("form").alias("key")).distinct()
        marked = digests.select("image_id", digest_form(F.col("sha256")).alias("key")).where("key IS NOT NULL").distinct()
        self.marked = cut(marked.join(self.known.select("image_id", "split").distinct(), "image_id"), "digests")
        self.forms = cut(_sizes(self.named), "forms")
        self.names = cut(form_pairs(self.forms.withColumnRenamed("key", "form")), "pairs")
        self.sums = cut(_sizes(self.marked).where("n_train > 0 AND n_eval > 0"), "sums")


def overlaps(p: Pictures) -> DataFrame:
    """id_a, id_b: all pairs of one picture, one id in a training and one in an evaluation split, the smaller first."""
    same = p.sums.select(F.col("key").alias("a"), F.col("key").alias("b"))
    both = expanded(p.names, p.named, p.forms).unionByName(expanded(same, p.marked, p.sums)).where("t <> e")
    return both.select(F.least("t", "e").alias("id_a"), F.greatest("t", "e").alias("id_b")).distinct()


def report(p: Pictures, sources: DataFrame, cut) -> DataFrame:
    """split, source, n_pairs, n_images: confirmed pairs counted per evaluation split and source of the evaluation image.

    Counted from the sizes of classes, without a row a pair: images of one class have the same names and digests, so the
    pairs of a class are those by name and those by digest less those by both. `sources`: image_id, source (in any case,
    with blanks around). An image of several sources counts under the least, one of none under ''.
    """
    c = F.col
    key = lambda split: F.array_join(F.array_sort(F.collect_set(F.when(c("split") == split, c("form")))), "\n")
    img = p.known.groupBy("image_id").agg(key(TRAIN).alias("ft"), key(EVAL).alias("fe"), F.bit_or("split").alias("splits"), F.collect_set(F.when(c("split") == EVAL, c("part"))).alias("parts"))
    sums = p.marked.join(p.sums.select("key"), "key", "left_semi").groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set("key")), "\n").alias("g"))
    source = sources.select("image_id", F.lower(F.trim("source")).alias("source")).groupBy("image_id").agg(F.min("source").alias("source"))
    img = img.join(sums, "image_id", "left").join(source, "image_id", "left").withColumns({"g": F.coalesce("g", F.lit("")), "source": F.coalesce("source", F.lit(""))})
    img = cut(img, "classes")
    train = cut(img.where(c("splits").bitwiseAND(TRAIN) != 0).groupBy("ft", "g").agg(F.count(F.lit(1)).alias("n")), "train")
    evals = img.where(c("splits").bitwiseAND(EVAL) != 0)

    def links(mine: DataFrame, t: str, theirs: DataFrame, e: str, pairs: DataFrame | None) -> DataFrame:
        """Classes of the two sides that share a digest, or names that are paired."""
        a = mine.where(c(t) != "").select(c(t).alias("kt")).distinct().withColumn("a", F.explode(F.split("kt", "\n")))
        b = theirs.where(c(e) != "").select(c(e).alias("ke")).distinct().withColumn("b", F.explode(F.split("ke", "\n")))
        met = a.join(pairs, "a").join(b, "b") if pairs is not None else a.join(b.withColumnRenamed("b", "a"), "a")
        return met.select("kt", "ke").distinct()

    by_name = cut(links(train, "ft", evals, "fe", p.names), "names").toDF("ft", "fe")
    by_sum = cut(links(train, "g", evals, "g", None), "links").toDF("gt", "ge")
    twice = evals.where(c("splits") == TRAIN | EVAL)  # an image is no pair with itself
    itself = twice.join(by_name, ["ft", "fe"], "left_semi").unionByName(twice.where("g <> ''")).select("image_id").distinct().withColumn("own", F.lit(1))
    classes = evals.join(itself, "image_id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    classes = cut(classes.select(F.explode("parts").alias("split"), "source", "fe", c("g").alias("ge"), "own").groupBy("split", "source", "fe", "ge", "own").agg(F.count(F.lit(1)).alias("n")), "evaluation")
    one = by_name.join(train.groupBy("ft").agg(F.sum("n").alias("n")), "ft").groupBy("fe").agg(F.sum("n").alias("n_name"))
    two = by_sum.join(train.groupBy(c("g").alias("gt")).agg(F.sum("n").alias("n")), "gt").groupBy("ge").agg(F.sum("n").alias("n_sum"))
    met = classes.where("fe <> '' AND ge <> ''").select("fe", "ge").distinct().join(by_sum, "ge").join(by_name, "fe")
    both = met.join(train.withColumnRenamed("g", "gt"), ["ft", "gt"]).groupBy("fe", "ge").agg(F.sum("n").alias("n_both"))
    x = classes.join(one, "fe", "left").join(two, "ge", "left").join(both, ["fe", "ge"], "left")
    x = x.withColumn("linked", F.coalesce("n_name", F.lit(0)) + F.coalesce("n_sum", F.lit(0)) - F.coalesce("n_both", F.lit(0)) - c("own"))
    return x.where("linked > 0").groupBy("split", "source").agg(F.sum(c("n") * c("linked")).alias("n_pairs"), F.sum("n").alias("n_images"))
