import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chatterscope.llm import fingerprint, queries


def rows_of(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdeé日😀", k=rnd.randint(1, 6))) for _ in range(300)]
    ids = rnd.sample(range(-50, 10 * n), n)
    return [(i, rnd.choice([" ", "\n", " \t"]).join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 3, 4, 5, 30, 200, 900])))) for i in ids]


@pytest.mark.parametrize("range_rows", [3, 50, 4000])
def test_edited_texts_equal_brute_force(spark, monkeypatch, range_rows):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", range_rows)
    rows = [*rows_of(1, 240), (10_000, None), (10_001, "last one")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sketch string").repartition(5)
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for (i, t), (j, u) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + u[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        mine = lambda s: {s[k : k + 16] for k in range(0, len(s), 16)}
        near = lambda a, b, same: len(a & b) / len(a | b) if a | b else float(same)
        assert r.near_edited == near(mine(r.fingerprint), mine(r.edited_fingerprint), t == edited)
        assert r.near_next == near(mine(r.fingerprint), mine(got[j].fingerprint), t == u)


def test_estimates_follow_the_sets(spark):
    rows = [r for r in rows_of(2, 300) if len(r[1].split()) > 100]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    ordered = sorted(rows)
    off = []
    for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        cut = len(t) // 4
        sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in ((s.lower()).split() for s in (t, t[: len(t) - cut] + u[:cut]))]
        off.append(got[i].near_edited - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
        assert len(got[i].fingerprint) / 16 == pytest.approx(len(sets[0]) / 8, abs=6 * (len(sets[0]) / 8) ** 0.5)
    assert abs(sum(off) / len(off)) < 0.03 and max(map(abs, off)) < 0.35


def test_sketches_merge(spark):
    a, b = "one two three four five six seven eight " * 1 + "x " * 50, " ".join(map(str, range(400)))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    s = lambda c: fingerprint.sketch(F.col(c))
    r = df.select(fingerprint.merged(s("a"), s("b")).alias("m"), s("a").alias("x"), s("b").alias("y"), fingerprint.containment(s("b"), fingerprint.merged(s("a"), s("b"))).alias("c")).first()
    assert r.m == sorted({*r.x, *r.y}) and r.c == 1.0 and len(set(r.x)) == len(r.x)


def test_edges(spark):
    rows = [(None, "no id here " * 9), (None, None), (5, "same text of six words here"), (5, "same text of six words here"), (9, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint.fingerprints(docs).collect()
    assert len(got) == len(rows)
    alone = {r.n_chars: r for r in got if r.doc_id is None}
    text = "no id here " * 9
    assert alone[99].edited_sha256 == hashlib.sha256(text[: 99 - 24].encode()).hexdigest() and alone[99].near_next == 0
    assert alone[0].near_next == alone[0].near_edited == 1.0
    five = [r for r in got if r.doc_id == 5]
    assert len({r.fingerprint for r in five}) == 1 and {r.near_next for r in five} in ({0.0, 1.0}, {1.0})
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0
    one = fingerprint.fingerprints(docs.where("doc_id = 9")).collect()
    assert [(r.n_chars, r.near_next, r.fingerprint) for r in one] == [(0, 1.0, "")]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(rows_of(3, 20), "doc_id long, text string")
    plan = fingerprint.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")) and plan.count("Exchange hashpartitioning") == 1


def test_estimates_of_short_texts_in_the_query(spark, tmp_path):
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choices("abcdefg", k=rnd.randint(1, 6))) for _ in range(300)]
    rows = [(k, " ".join(rnd.choices(vocabulary, k=rnd.randint(5, 50)))) for k in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op10_fingerprint(spark, str(tmp_path)).collect()}
    off, lost = [], 0
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(t) // 4
        sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in (s.split() for s in (t, t[: len(t) - cut] + u[:cut]))]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        off.append(abs(got[i].near_edited - true))
        lost += true >= 0.4 and got[i].near_edited == 0
    assert sum(off) / len(off) < 0.1 and sum(x > 0.25 for x in off) <= 30 and lost <= 2
