import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram
from tokenizers.pre_tokenizers import Metaspace

from chatterscope.llm import unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = unigram.vocabulary(PATH)


def library(pieces, byte_fallback):
    t = Tokenizer(Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = Metaspace(replacement=unigram.MARK, prepend_scheme="always", split=True)
    return t


LIBRARY = library(VOCABULARY, True)
EDGES = ["", " ", "  ", "a", "Hello  world", " lead", "trail ", "▁mark", "日本語 😀👍🏽 x", "\n\t\r", "a\nb c", "é" * 50, "ⰀⰁ ⰂⰃ", "<s> <0x41> <unk>", "the " * 300, "x" * 2000]


@pytest.mark.parametrize("text", EDGES)
def test_edges_equal_library(text):
    assert unigram.counter(PATH).count(text)[0] == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("aehinorst' .▁é\n", max_size=60)))
def test_any_text_equals_library(text):
    assert unigram.counter(PATH).count(text)[0] == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text("abcd xy", max_size=30), st.lists(st.tuples(st.text("abcd▁", min_size=1, max_size=4), st.sampled_from([-1.0, -2.0, -3.0, -0.5])), min_size=1, max_size=14, unique_by=lambda p: p[0]))
def test_ties_and_unknowns_equal_library(text, pieces):
    """Few scores, so that many segmentations tie."""
    pieces = [("<unk>", 0.0), *pieces]
    want = library(pieces, False).encode(text, add_special_tokens=False).ids
    assert unigram.Counter(pieces).count(text)[0] == len(want)


def test_best_score_equals_all_segmentations():
    scores = {"a": -1.5, "b": -2.0, "ab": -3.0, "ba": -2.5, "aba": -5.0, "bb": -3.75, unigram.MARK: -1.0, unigram.MARK + "a": -2.25}
    counter = unigram.Counter([("<unk>", 0.0), *scores.items()])

    def best(s):
        return max((scores[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in scores), default=0.0 if not s else float("-inf"))

    for n in range(9):
        for k in range(2**n):
            s = unigram.MARK + "".join("ab"[k >> i & 1] for i in range(n))
            assert counter.segmented(s)[1] == best(s)


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(EDGES)] + [(None, "null id", "x"), (4, EDGES[4], "x"), (99, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted(((r.doc_id, r.n_tokens) for r in unigram.counts(docs, PATH).collect()), key=str)
    assert got == sorted(((i, len(LIBRARY.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows), key=str)
    assert unigram.counts(docs.limit(0), PATH).count() == 0


def test_small_memory_changes_nothing():
    small = unigram.Counter(VOCABULARY, remembered=1)
    assert small.count("the cat sat on the mat the cat") == unigram.counter(PATH).count("the cat sat on the mat the cat")
