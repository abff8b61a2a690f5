import random
import re
import zlib

import numpy as np
import pytest

from chatterscope.llm import toxicity, words


def test_words_are_runs_of_letters_and_digits():
    texts = ["Ab, ab! é9x--q", "", "...", "q AB", "x" * 5000]
    found, owner = words.hashes([t.encode() for t in texts], words.MARKS)
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode().lower())]
    assert owner.tolist() == [i for i, _ in want]
    same = {}
    for h, (_, w) in zip(found.tolist(), want, strict=True):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


def test_shingles_equal_one_by_one():
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices("ab cd ef g".split(), k=rnd.randint(0, 9))).encode() for _ in range(60)]
    found, owner = words.hashes(texts, words.WHITE)
    got, whose = words.shingles(found, owner, len(texts), 3)
    sets = {}
    for h, i in zip(got.tolist(), whose.tolist(), strict=True):
        sets.setdefault(i, set()).add(h)
    want = {}
    for i, t in enumerate(texts):
        ws = t.split()
        if ws:
            want[i] = {tuple(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))}
    assert {i: len(s) for i, s in sets.items()} == {i: len(s) for i, s in want.items()}
    for i in want:
        for j in want:
            assert len(sets[i] & sets[j]) == len(want[i] & want[j])


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    made = []
    for i in range(1500):
        toxic = i % 8 == 0
        ws = ["".join(rnd.choices(["ka", "lo", "mi", "tu"], k=rnd.randint(1, 4))) for _ in range(rnd.randint(10, 200))]
        if toxic:
            for _ in range(rnd.randint(2, 6)):
                ws.insert(rnd.randrange(len(ws)), rnd.choice(["Vile", "rotten!", "grubx" + rnd.choice("abcdefgh") * 3]))
        made.append((i, " ".join(ws), int(toxic)))
    return made


def frames(spark, rows, odd=()):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + list(odd), "doc_id long, text string, wanted string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if i % 2 == 0 or x] + [(None, 1), (3, None), (8, 1)], "doc_id long, toxic int")
    return docs, labels


def test_held_out_accuracy(spark, rows):
    docs, labels = frames(spark, rows)
    got = {r.doc_id: r for r in toxicity.detect(docs, labels).collect()}
    truth = {i: x for i, _, x in rows}
    held = [i for i in got if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    flagged = {i for i in held if got[i].predicted}
    toxic = {i for i in held if truth[i]}
    assert len(flagged & toxic) >= 0.95 * len(toxic) and len(flagged - toxic) <= 0.02 * len(held)


def test_held_out_labels_are_not_read(spark, rows):
    docs, labels = frames(spark, rows)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    a = {r.doc_id: r.score for r in toxicity.detect(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.detect(docs, turned).collect()}


def test_edges(spark, rows):
    odd = [(5000, None, "x"), (5001, "", "x"), (None, "vile rotten", "x"), (5, rows[5][1], "x"), (5002, "kalo " * 100_000 + "vile rotten", "x")]
    docs, labels = frames(spark, rows, odd)
    got = toxicity.detect(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score < 0.5 and by[5000].predicted == 0
    assert by[5002].predicted == by[None].predicted == 1
    assert toxicity.detect(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.detect(docs, labels.limit(0)).collect()} == {0}


def test_negative_estimates_turn_the_step():
    """With the unlabelled texts as toxic as the prior says, toxic ones among them still get high scores."""
    rng = np.random.default_rng(0)
    toxic = [np.unique(rng.integers(0, 5, 3)).astype(np.uint64) for _ in range(300)]
    clean = [np.unique(rng.integers(100, 200, 5)).astype(np.uint64) for _ in range(900)]
    model = toxicity.fit(toxic[:200], toxic[200:] + clean, 0.1)
    odds = model.bias + np.array([model.weights[np.isin(model.known, s)].sum() for s in toxic + clean])
    assert (odds[:300] > 1).mean() > 0.95 and (odds[300:] < 0).all()
