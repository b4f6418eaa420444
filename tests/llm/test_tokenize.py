import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataspark.llm import tokenize

pytestmark = pytest.mark.skipif(not os.path.exists(tokenize.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def tools():
    import tiktoken

    content = open(tokenize.VOCABULARY, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tokenize.load(content), tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=60) | st.lists(st.sampled_from(["a", "b", " ", "\n", "é", "中", "🧩", "'s", "​", "ing", "===", "  ", "<|endoftext|>", "1"]), max_size=40).map("".join))
def test_equals_public_library(tools, text):
    v, public = tools
    ids = v.encode(text)
    assert ids == public.encode_ordinary(text)
    assert v.decode(ids).decode() == text


def test_long_pieces(tools):
    v, public = tools
    rng = random.Random(2)
    for text in ("a" * 30_000, "ab" * 15_000, " " * 9000 + "x", "中" * 5000, "".join(rng.choice("abcdefgh") for _ in range(30_000))):
        assert v.encode(text) == public.encode_ordinary(text)


def test_frames(spark, tools):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (3, None, "x"), (4, "naïve 🧩\r\n", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = tokenize.encode(df, "doc_id", "text")
    by = {r.doc_id: r.ids for r in got.collect()}
    assert by[1] == tools[1].encode_ordinary("Hello world") and by[2] == by[3] == [] and got.count() == 5
    assert {r.doc_id: r.text for r in tokenize.decode(got, "doc_id").collect()} == {1: "Hello world", 2: "", 3: "", 4: "naïve 🧩\r\n"}
    assert tokenize.encode(df.limit(0), "doc_id", "text").count() == 0
