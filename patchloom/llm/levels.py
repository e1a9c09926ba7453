"""Reading level by smoothed unigram language models, one a band, trained on texts rated by hand.

A document's band is the one of largest posterior: log prior plus the sum of log probabilities of its prose words under
the band's model (add-alpha smoothing over the joint vocabulary and one unknown word). The training set is bounded
(`max_samples`), so the model is too, and goes to the tasks with the function.

Prose is what remains of a text without marked code (fenced by ``` or ~~~, indented by four spaces or a tab, in <pre>),
quoted lines, links and markup. Defined results. A null, empty or blank text, one of fewer than
`min_words` prose words, or one of another language has no band. Ties go to the lower band. Very long texts are read whole.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MIN_WORDS = 40

_FENCE = re.compile(r"^ {0,3}(```+|~~~+)")
_PRE = re.compile(r"<pre\b.*?(?:</pre\s*>|\Z)", re.I | re.S)
_LINKS = [
    (re.compile(r"^ {0,3}\[[^\]\n]+\]:.*$", re.M), " "),  # definitions of links
    (re.compile(r"<a\b[^>]*>(.*?)</a\s*>", re.I | re.S), r" "),
    (re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)"), r" "),
    (re.compile(r"\b(?:https?|ftp)://[^\s<>\"')\]]+", re.I), " "),
    (re.compile(r"\bwww\.[^\s<>\"')\]]+", re.I), " "),
]
_QUOTE = re.compile(r"<blockquote\b.*?(?:</blockquote\s*>|\Z)", re.I | re.S)
_TAG = re.compile(r"<[^<>\n]{1,200}>")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_HIDDEN = re.compile(r"[­​-‏⁠﻿\x00-\x08\x0b\x0c\x0e-\x1f]")


def prose(text: str) -> str:
    text = _HIDDEN.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    text = _PRE.sub("\n", text)
    kept, fence = [], ""
    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1].startswith(fence) and not line.strip().strip(fence[0]):
                fence = ""
            continue
        if mark:
            fence = mark[1]
        elif not line.startswith(("    ", "\t")) and not line.lstrip().startswith(">") and not line.lstrip().startswith("&gt;"):
            kept.append(line)
    text = _QUOTE.sub("\n", "\n".join(kept))
    for pattern, instead in _LINKS:
        text = pattern.sub(instead, text)
    return html.unescape(_TAG.sub(" ", text))


def words(text: str | None) -> list[str]:
    return [w.replace("’", "'") for w in _WORD.findall(prose(text).lower())] if text else []


def train(samples: list[tuple[str, str]], alpha: float = 0.1) -> tuple[list[str], dict[str, list[float]], list[float]]:
    """Bands in the order of `samples`' first appearance; log probabilities of each word; those of an unknown word plus priors."""
    bands = list(dict.fromkeys(b for _, b in samples))
    counts = {b: Counter() for b in bands}
    for text, band in samples:
        counts[band].update(words(text))
    vocabulary = sorted(set().union(*counts.values()))
    size = len(vocabulary) + 1
    totals = [sum(counts[b].values()) + alpha * size for b in bands]
    model = {w: [math.log((counts[b][w] + alpha) / t) for b, t in zip(bands, totals)] for w in vocabulary}
    return bands, model, [math.log(sum(x == b for _, x in samples) / len(samples)) for b in bands]


def classify(tokens: list[str], bands: list[str], model: dict[str, list[float]], priors: list[float]) -> str:
    """A word unknown to all bands tells nothing of the band, and is passed over."""
    scores = list(priors)
    for word, n in Counter(tokens).items():
        if p := model.get(word):
            for i, x in enumerate(p):
                scores[i] += n * x
    return bands[scores.index(max(scores))]


def is_english(lang: Column) -> Column:
    """Language en apart from case and region."""
    return F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]+)", 1) == "en"


def training_rows(samples: DataFrame, order: list[str], max_samples: int = 100_000) -> list[tuple[str, str]]:
    """(text, band) of the rated texts, bands from easy to hard; at most `max_samples`, the least ids first."""
    rows = samples.where(F.col("band").isin(order) & F.col("text").isNotNull()).dropDuplicates(["sample_id"])
    rows = rows.orderBy("sample_id").limit(max_samples).select("text", "band").collect()
    return sorted(((r["text"], r["band"]) for r in rows), key=lambda r: order.index(r[1]))


def levels(documents: DataFrame, samples: list[tuple[str, str]], min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, band, n_words of each document with a band. `documents`: doc_id, text, lang; other columns are ignored."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("band", T.StringType()), T.StructField("n_words", T.LongType())])
    if not samples:
        return documents.sparkSession.createDataFrame([], schema)
    bands, model, priors = train(samples)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                tokens = words(text.as_py())
                if len(tokens) >= min_words:
                    out.append((doc_id.as_py(), classify(tokens, bands, model, priors), len(tokens)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return documents.where(is_english(F.col("lang")) & F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(run, schema)
