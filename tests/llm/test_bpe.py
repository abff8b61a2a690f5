import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chatterscope.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
EDGES = [
    "", " ", "\n\t", "Hello, World's 123 DON'T we'll", "a" * 3000, "<|endoftext|>", "x<|startoftext|>y <|endoftext|> z",
    "<|endo", "ΑΣ ΟΔΟΣ İstanbul ǅ ß ﬃ", "é Å", "a\x1cb\x1fc\x85d\xa0e​f g", "日本語テスト 😀👍🏽", "½²³ ٣٤",
    "’s 's 'S '’re", "..!?;--==", "İ̇", "à́" * 50, "\x00\x01", "क्षि नमस्ते",
]


def check(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert bpe.ids_of(text, PATH) == want
    runs = bpe.encoder(PATH).encode(text)
    assert " ".join(r[2] for r in runs) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", EDGES)
def test_edges_equal_library(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("aehinorst' .,0<|>endoftxt\n", max_size=60)))
def test_any_text_equals_library(text):
    check(text)


def test_small_memory_changes_nothing():
    enc = bpe.Encoder(bpe.Merges(PATH), remembered=2)
    text = "the quick brown fox's the quick lazy dogs jumped"
    ids = [int(i) for r in enc.encode(text) for i in r[0].split()]
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(EDGES)] + [(None, "null id", "x"), (3, EDGES[3], "x"), (99, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(docs, PATH).collect()
    assert len(got) == len(rows)
    want = set()
    for i, text, _ in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((i, len(ids), digest(" ".join(map(str, ids))), digest(LIBRARY.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in got} == want
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
