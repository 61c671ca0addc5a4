from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataform.llm import tokens
from tests.conftest import rows

TEXTS = [
    None,
    "",
    "   ",
    "\n\n \t x",
    "Hello world, it's   done!!\r\n\r\nEnd ",
    "a<|endoftext|>b",
    "Straße ½ ²³ Ⅳ 12345 ñandú",
    "日本語のテキスト、中文 и русский",
    "👩‍💻 zero​width nbsp\u0085nel ls",
    "new letters \U0002ebf0\U000105c0 mixed",
    "'s 't'll''ve ' 's",
    "x" * 20_000 + " " * 5_000 + "é" * 3_000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.load(tokens.default_path())


def plain(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids if text else []


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_ids_equal_the_tokenizer_and_decode_back(spark, tokenizer):
    ids = tokens.encode(frame(spark, TEXTS))
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: plain(tokenizer, t) for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in tokens.decode(ids).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_random_unicode(spark, tokenizer):
    rnd = random.Random(1)
    points = [c for c in (rnd.randrange(0x110000) for _ in range(4000)) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chr(c) + rnd.choice(["", " ", "a", "'s", "\n"]) for c in points[i : i + 40]) for i in range(0, len(points), 40)]
    assert {r.doc_id: r.ids for r in tokens.encode(frame(spark, texts)).collect()} == {i: plain(tokenizer, t) for i, t in enumerate(texts)}


def test_words_beyond_the_broadcast_bound(spark, tokenizer):
    texts = [*TEXTS, *["the cat and the dog and the bird"] * 20, *[f"word{i} tail {i}" for i in range(50)]]
    for n_hot in (0, 5, 1000):
        ids = tokens.encode(frame(spark, texts), limit=1, n_hot=n_hot)
        assert {r.doc_id: r.ids for r in ids.collect()} == {i: plain(tokenizer, t) for i, t in enumerate(texts)}


def test_repeated_rows_empty_table_and_extra_columns(spark, tokenizer):
    df = spark.createDataFrame([(1, "a b a", "x"), (1, "a b a", "y"), (2, None, "z")], "doc_id bigint, text string, ids string")
    assert rows(tokens.encode(df)) == [(1, plain(tokenizer, "a b a")), (2, [])]
    assert rows(tokens.encode(spark.createDataFrame([], "doc_id bigint, text string"))) == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_distinct_words_can_be_encoded_alone(text):
    tokenizer = tokens.load(tokens.default_path())
    cut = [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    assert "".join(cut) == text
    assert [i for w in cut for i in plain(tokenizer, w)] == plain(tokenizer, text)
