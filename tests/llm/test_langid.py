import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from chatterscope.llm import langid

SYLLABLES = {"aa": "ka lo mi tu ne", "bb": "schr ung ei ach zu", "cc": "ción llo que es ñar", "dd": "日 本 語 学 校"}


def text(lang, n, rnd):
    return " ".join("".join(rnd.choices(SYLLABLES[lang].split(), k=rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    return [(i, text(lang, rnd.randint(5, 80), rnd), lang, "x") for i, lang in enumerate(rnd.choices(list(SYLLABLES), k=400))]


def brute(text, dimensions):
    """One n-gram at a time."""
    lows = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in f" {text} ")
    lows = " ".join(lows.split()).join("  ")
    total = np.zeros(dimensions)
    vector = lambda c: np.random.default_rng([langid.SEED, ord(c)]).integers(0, 2, dimensions, np.int8) * 2 - 1
    for a, b, c in zip(lows, lows[1:], lows[2:], strict=False):
        if b != " ":
            total += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return total


def test_profiles_equal_one_by_one():
    texts = ["Über die Straße", "", "  ", "a", "x1y", "日本語 the", "İstanbul ẞ", "AB ab!ab", "zz " * 40]
    got = langid.profiles(texts, 64)
    for t, row in zip(texts, got, strict=True):
        assert np.array_equal(row, brute(t, 64)), t


def test_many_symbols_go_in_blocks(monkeypatch):
    rnd = random.Random(1)
    texts = ["".join(chr(rnd.randint(0x4E00, 0x5E00)) for _ in range(300)) for _ in range(3)]
    want = langid.profiles(texts, 32)
    monkeypatch.setattr(langid, "BLOCK", 50)
    assert np.array_equal(langid.profiles(texts, 32), want)


def test_held_out_accuracy(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(i, lang) for i, _, lang, _ in rows if got[i].held_out]
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark, rows):
    odd = [(1000, None, "aa", "x"), (1001, "", "aa", "x"), (1002, "12 !?", None, "x"), (None, "kalo mitu", None, "x"),
           (5, rows[5][1], "aa", "x"), (1003, "kalomitu " * 50_000, None, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, p string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0)
    assert by[1003][0] == by[None][0] == "aa"
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_accepted_keeps_columns_and_clean_rows(spark, rows):
    docs = spark.createDataFrame([*rows, (900, "!!", "aa", "x"), (901, None, None, "x")], "doc_id long, text string, lang string, Predicted string")
    kept = langid.accepted(docs, 0.01)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows}


def test_gibberish_and_unlearned_scripts_go(spark, rows):
    rnd = random.Random(9)
    word = lambda letters: "".join(rnd.choices(letters, k=rnd.randint(2, 10)))
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x430, 0x450)))
    clean = [text(lang, n, rnd) for lang in SYLLABLES for n in [1] * 20 + [300] * 5]
    junk = [" ".join(word(letters) for _ in range(100)) for letters in (latin, cyrillic, latin + "0123456789+/") for _ in range(30)]
    junk += [word(cyrillic) for _ in range(30)]
    odd = [(1000 + k, t, None, "x") for k, t in enumerate(clean + junk)]
    kept = langid.accepted(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, p string"), corpus_pipeline.LEAST_LANGUAGE)
    ids = {r.doc_id for r in kept.collect()}
    assert {r[0] for r in rows} <= ids
    assert len(ids & {1000 + k for k in range(len(clean))}) >= len(clean) - 1  # a word may be noise to its language
    assert not ids & {1000 + len(clean) + k for k in range(len(junk))}
