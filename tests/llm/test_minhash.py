import random

import pytest

from chatterscope.llm import minhash, shared
from chatterscope.llm.components import merged
from chatterscope.llm.minhash import Likeness


def shingles(text, width):
    ws = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(ws[k : k + width]) for k in range(max(1, len(ws) - width + 1))} if ws else set()


def brute(rows, like):
    sets = [shingles(t, like.width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and like.parts * both >= like.share * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    members = {}
    for k in range(len(rows)):
        members.setdefault(root(k), []).append(rows[k][0])
    low = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    return [(i, len(sets[k]), low[root(k)], i == low[root(k)]) for k, (i, _) in enumerate(rows)]


def corpus(seed, groups, per_group, words, changes):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdeé", k=4)) for _ in range(400)]
    out = []
    for _ in range(groups):
        base = rnd.choices(vocabulary, k=words)
        for _ in range(rnd.randint(1, per_group)):
            ws = list(base)
            for _ in range(rnd.randint(0, changes)):
                ws[rnd.randrange(len(ws))] = rnd.choice(vocabulary)
            out.append(rnd.choice([" ", "\n"]).join(ws) if rnd.random() < 0.7 else " ".join(ws).upper())
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("like", [Likeness(3, 85), Likeness(5, 80)])
def test_equal_to_brute_force(spark, like):
    texts = corpus(1, 40, 12, 80, 5) + ["", None, " \t", "one", "One", "one two", "one  two", "two one", "x\xa0y", "word " * 3000]
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)] + [(7, texts[1]), (None, texts[2]), (None, "all alone here it is"), (None, "all alone here it is")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, minhash string").repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id, bool(r.kept)) for r in minhash.components(docs, like).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, like), key=str)


def test_many_members_at_the_threshold(spark, monkeypatch):
    """A group whose pairs lie on both sides of the threshold, compared in small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 2000)
    monkeypatch.setattr(minhash, "LEADER_ROUNDS", 1)
    like = Likeness(3, 85)
    rows = list(enumerate(corpus(5, 3, 150, 120, 5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.components(docs, like).collect()]
    assert sorted(got) == sorted(brute(rows, like))


@pytest.mark.parametrize("values", [0, 1_000_000])
def test_representatives_keep_rows_whole(spark, monkeypatch, values):
    monkeypatch.setattr(shared, "BROADCAST_VALUES", values)
    like = Likeness(5, 80)
    rows = [(i, t, f"s{i}") for i, t in enumerate(corpus(3, 20, 6, 60, 2))] + [(900, None, "n"), (901, "", "e"), (902, "something else", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Label string").repartition(3)
    kept = minhash.representatives(docs, like)
    assert kept.columns == docs.columns
    want = brute([r[:2] for r in rows], like)
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == len({c for i, n, c, _ in want if n}) + 2 and set(got) <= set(rows)
    assert minhash.representatives(docs.limit(0), like).count() == 0 == minhash.components(docs.limit(0), like).count()


def test_components_of_a_path_and_of_stars(spark):
    rnd = random.Random(0)
    path = [(k, k + 1) for k in range(60)] + [(100, 140), (100, 120), (120, 130), (141, 140), (200, 201)]
    rnd.shuffle(path)
    nodes = sorted({x for e in path for x in e} | {300})
    labels = spark.createDataFrame([(n, n) for n in nodes], "node long, label long")
    got = dict(merged(labels, spark.createDataFrame([e if rnd.random() < 0.5 else e[::-1] for e in path], "a long, b long")).collect())
    assert got == {n: 0 if n <= 60 else 100 if n < 150 else 200 if n < 300 else 300 for n in nodes}
