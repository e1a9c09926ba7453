import random

from patchloom.llm import levels
from patchloom.llm.queries import BANDS
from patchloom.session import table

LINE = "the old dog sat on the mat and ate a fish in the sun "


def test_prose_leaves_out_code_quotes_and_links():
    text = "keep one\n```python\ndrop\n```\n~~~\ndrop\n~~~\n    drop indented\n> drop quoted\n<pre><code>drop\ndrop</code></pre>\nkeep [drop this](http://drop.example/x) two <a href='http://d'>drop</a> https://drop.example/y?z=1\n[1]: http://drop.example\n<p>keep &amp; three</p>\n```\ndrop to the end"
    assert levels.words(text) == ["keep", "one", "keep", "two", "keep", "three"]
    assert levels.words("It’s\r\nso so​ft\r> drop") == ["it's", "so", "soft"]
    assert levels.words(None) == levels.words("") == levels.words(" \n\t ") == []


def samples(spark):
    return levels.training_rows(table(spark, "/root/testdata/sf0.001", "level_samples"), BANDS)


def test_held_out_accuracy(spark):
    rows = samples(spark)
    order = list(range(len(rows)))
    random.Random(1).shuffle(order)
    right = 0
    for fold in range(5):
        held = set(order[fold::5])
        model = levels.train([r for i, r in enumerate(rows) if i not in held])
        right += sum(levels.classify(levels.words(rows[i][0]), *model) == rows[i][1] for i in held)
    assert right / len(rows) >= 0.97


def test_which_documents_get_a_band(spark):
    rated = samples(spark)
    long = rated[0][0]
    docs = [(1, long, "en"), (2, long, "EN-us"), (3, long, " en_GB "), (4, long, "eng"), (5, long, "de"), (6, long, None), (7, None, "en"), (8, "", "en"), (9, LINE * 2, "en"), (10, LINE * 4, "en"), (11, "```\n" + LINE * 9, "en"), (12, LINE * 40_000, "en")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id BIGINT, text STRING, lang STRING, band STRING")
    out = {r["doc_id"]: (r["band"], r["n_words"]) for r in levels.levels(df, rated).collect()}
    assert set(out) == {1, 2, 3, 10, 12} and out[1][0] == rated[0][1] and out[12][1] == 14 * 40_000
    assert levels.levels(df.limit(0), rated).count() == 0 and levels.levels(df, []).count() == 0


def test_training_leaves_out_unrated_and_repeated_rows(spark):
    rows = [(1, "a b", "basic"), (1, "a b", "basic"), (2, None, "mid"), (3, "c", None), (4, "d", "other"), (5, "", "adv")]
    df = spark.createDataFrame(rows, "sample_id BIGINT, text STRING, band STRING")
    assert levels.training_rows(df, BANDS) == [("a b", "basic"), ("", "adv")]


def test_ties_go_to_the_easier_band():
    model = levels.train([("cat", "basic"), ("cat", "adv")])
    assert levels.classify(["cat", "unknown"], *model) == "basic"
