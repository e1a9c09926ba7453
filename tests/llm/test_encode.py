import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patchloom.llm import encode
from patchloom.llm.tokens import FOLDER, encoder, token_counts

pieces = st.sampled_from(["the cat", " sat", "\n\n", "  ", "don't", "日本語", "é", "　", "\xa0", "x" * 40, "1234567", "<|endoftext|>", "🙂", "\r\n", "!?", "ab ", "\x85", "नमस्ते", "'s", "\t"])
text = st.lists(pieces, max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(text, st.integers(4, 40))
def test_repaired_chunks_encode_as_the_whole(text, longest):
    raw = text.encode()
    if not raw:
        return
    enc = encoder()
    ends, safe = encode.chunk_ends(raw, longest)
    cuts = [0, *ends]
    parts = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
    assert b"".join(parts) == raw and all(parts) and max(map(len, parts)) <= longest
    assert encode.repair([enc.encode_ordinary(p.decode()) for p in parts], safe, enc) == enc.encode_ordinary(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(text.filter(bool), min_size=1, max_size=6))
def test_texts_are_cut_together_as_alone(texts):
    raws = [t.encode() for t in texts]
    assert encode.chunk_many(raws) == [encode.chunk_ends(r) for r in raws]


def test_equal_passages_share_chunks():
    rng = np.random.default_rng(0)
    words = lambda n: "\n".join("".join(rng.choice(list("abcdefghij"), 25)) for _ in range(n))
    shared = words(400)
    both = []
    for _ in range(2):
        raw = (words(30) + "\n" + shared).encode()
        ends = encode.chunk_ends(raw)[0]
        both.append({raw[a:b] for a, b in zip([0, *ends], ends)})
    assert sum(map(len, both[0] & both[1])) > 0.8 * len(shared)


DOCS = "doc_id BIGINT, text STRING, ids STRING, key STRING"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], DOCS)


def test_whole_corpus(spark):
    hot = "the very same line of words again and again.\n"
    texts = [None, "", " ", "\n", "<|endoftext|> is text", hot * 50, hot * 3, "x" * 50_000, "日本語のテキスト" * 900, "a " * 30_000, "odd \x00\x07 ﻿​ end", hot * 50]
    df = documents(spark, texts)
    got = {r["doc_id"]: r["ids"] for r in encode.encode(df).collect()}
    assert got == {i: encoder().encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


def test_memory_is_bounded_and_changes_nothing():
    enc = encoder()
    calls = []

    def encode_one(text):
        calls.append(text)
        return np.array(enc.encode_ordinary(text), np.uint32)

    small = encode.Memory(encode_one, most=2_000)
    for i in [*range(50), *range(50), 0, 0, 0]:
        assert small.ids(f"line {i}".encode()).tolist() == enc.encode_ordinary(f"line {i}")
        assert len(small.young) + len(small.old) < 25
    assert calls[-1] == "line 0" and calls.count("line 0") < 5
    large = encode.Memory(encode_one)
    calls.clear()
    for _ in range(3):
        large.ids(b"again")
    assert calls == ["again"]


def test_repeated_rows_each_keep_a_row_and_empty_tables(spark):
    df = documents(spark, ["one two three"])
    assert [r["ids"] for r in encode.encode(df.union(df)).collect()] == [encoder().encode_ordinary("one two three")] * 2
    assert encode.encode(df.limit(0)).count() == 0


def test_agrees_with_the_other_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for s in ("Hello  there,\n\n it's <|endoftext|> 12345 日本 　x", "   ", "\t\ta'b"):
        assert t.encode(s, add_special_tokens=False).ids == encoder().encode_ordinary(s)
