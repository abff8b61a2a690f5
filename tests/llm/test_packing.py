import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chatterscope.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("aehinorst' .,0<|>endoftxt\n \x1c\xa0\t’", max_size=60)))
def test_ids_equal_library(text):
    assert np.frombuffer(packing.ids_for(PATH).of(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_cut():
    assert packing.cut(1) == [(0, 1)]
    assert packing.cut(2048) == [(0, 2048)]
    assert packing.cut(5000) == [(0, 904), (904, 2048), (2952, 2048)]


def test_patterns_fill():
    found = packing.patterns(12)
    assert len(set(found)) == len(found) and all(sum(p) == 12 and len(p) <= 3 for p in found)
    want = {tuple(sorted((a, b, 12 - a - b), reverse=True)) for a in range(1, 11) for b in range(1, 12 - a)}
    assert {p for p in found if len(p) == 3} == want


def test_least_squares_meets_the_conditions():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12) * rng.integers(1, 50)
        x = packing.least_squares(a, b)
        slope = a.T @ (a @ x - b)
        assert (x >= 0).all() and slope.min() > -1e-6 * 50 and abs(slope @ x) < 1e-5 * 50


HISTOGRAMS = {
    "mixed": Counter(min(2048, int(random.Random(i).lognormvariate(6.4, 1)) + 1) for i in range(20000)),
    "tiny": Counter({3: 1000, 50: 999, 7: 1}),
    "over half": Counter({1025: 100, 1300: 7}),
    "one": Counter({17: 1}),
    "full": Counter({2048: 5}),
    "hot": Counter({700: 100_000, 1348: 2, 5: 3}),
    "none": Counter(),
}


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_plan_holds_everything(name):
    histogram = HISTOGRAMS[name]
    groups = packing.plan(histogram)
    held = Counter()
    for lengths, times in groups:
        assert sum(lengths) <= 2048 and times > 0
        for n in lengths:
            held[n] += times
    assert held == histogram
    total, used = sum(n * c for n, c in histogram.items()), sum(t for _, t in groups)
    least = max(-(-total // 2048), sum(c for n, c in histogram.items() if n > 1024))
    assert used <= {"hot": 50_002}.get(name, least * 1.002 + 1)


def best_fit_decreasing(histogram, size=2048):
    """Sequences that it takes, one piece at a time."""
    rooms, used = Counter(), 0
    for n in sorted(histogram.elements(), reverse=True):
        room = min((r for r, c in rooms.items() if c and r >= n), default=None)
        if room is None:
            used, room = used + 1, size
        else:
            rooms[room] -= 1
        rooms[room - n] += 1
    return used


@pytest.mark.parametrize("name", [n for n in HISTOGRAMS if n != "hot"])
def test_plan_is_never_worse_than_best_fit_decreasing(name):
    assert sum(times for _, times in packing.plan(HISTOGRAMS[name])) <= best_fit_decreasing(Counter(HISTOGRAMS[name]))


@pytest.mark.parametrize("scale, sequences", [("0.001", None), ("0.01", 481)])
def test_plan_of_documents(spark, scale, sequences):
    docs = spark.read.parquet(f"/root/testdata/sf{scale}/documents.parquet")
    histogram = Counter({r["length"]: r["count"] for r in packing.pieces(docs, PATH).groupBy("length").count().collect()})
    used = sum(times for _, times in packing.plan(histogram))
    assert used <= best_fit_decreasing(histogram) and used <= (sequences or used)


def test_rows(spark):
    rnd = random.Random(5)
    words = [w for w in "the of and inthe rest ation über ça 12 ,;".split()]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([0, 1, 5, 60, 400, 900, 3000]))) for _ in range(200)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, "no id", "x"), (900, None, "x"), (901, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(5)
    got = packing.pack(docs, PATH).collect()
    sequences, by_doc = defaultdict(list), defaultdict(set)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].add((r.piece, r.start, r.length, r.ids_crc32))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    want = 0
    for i, text, _ in rows:
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = packing.cut(len(ids))
        want += len(cuts)
        assert {(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts)} == by_doc[i]
    assert len(got) == want
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_ids_equal_library_on_all_texts(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toLocalIterator():
        assert np.frombuffer(packing.ids_for(PATH).of(r.text), "<u4").tolist() == LIBRARY.encode(r.text, add_special_tokens=False).ids


def test_ids_equal_library_on_every_letter():
    """Characters of each kind, alone and after others, where two libraries' tables might differ."""
    every = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1F000, 0x1F700), 0x323B0]]
    texts = ["a".join(every[i : i + 50]) + " ".join(every[i : i + 50]) for i in range(0, len(every), 50)]
    wrong = [t for t in texts if np.frombuffer(packing.ids_for(PATH).of(t), "<u4").tolist() != LIBRARY.encode(t, add_special_tokens=False).ids]
    assert not wrong, wrong[0]
