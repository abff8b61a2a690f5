import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from chatterscope.llm import shared, suffix
from chatterscope.llm.queries import QUERIES

T = suffix.THRESHOLD


def brute(texts, T=T):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + T] for t in raw for i in range(len(t) - T + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - T + 1):
            if seen[t[i : i + T]] > 1:
                gone[i] += 1
                gone[i + T] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, parts=4, threshold=T):
    rows = [(k * 7919 % 10007 if k % 17 else None, t, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repeated string").repartition(parts)
    got = sorted((tuple(r) for r in suffix.removals(docs, threshold).collect()), key=str)
    want = sorted(((r[0], *w) for r, w in zip(rows, brute(texts, threshold), strict=True)), key=str)
    assert got == want


def prose(rnd, n):
    return " ".join("".join(rnd.choices("abcdeéün", k=rnd.randint(1, 8))) for _ in range(n))


def test_passages_edits_and_copies(spark):
    rnd = random.Random(3)
    passages = [prose(rnd, n) for n in (60, 75, 80, 90, 150, 400)]
    texts = []
    for _ in range(150):
        t = prose(rnd, rnd.choice([5, 50, 200, 600]))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            cut = rnd.randint(0, len(p) // 3)
            at = rnd.randint(0, len(t))
            t = t[:at] + p[cut : len(p) - rnd.randint(0, 40)] + t[at:]
        texts.append(t)
    for _ in range(60):  # near copies
        t = list(rnd.choice(texts[:20]))
        for _ in range(rnd.randint(0, 4)):
            if t:
                t[rnd.randrange(len(t))] = rnd.choice("xyzß")
        texts.append("".join(t))
    texts += [texts[5], texts[5], texts[7], None, "", "short", "short"]
    check(spark, texts)
    check(spark, texts, threshold=250)
    check(spark, texts, threshold=192)


def test_lengths_around_the_threshold(spark):
    rnd = random.Random(8)
    base = "".join(rnd.choices("abcdefgh", k=1200))
    texts = [base[i : i + n] + str(i) * 3 for i in range(0, 300, 37) for n in (398, 399, 400, 401, 402, 463, 500)]
    texts += [base[100:500], base[100:500], base[101:500], "z" + base[100:500], base[700:1100] + "y", "w" + base[700:1100], base]
    check(spark, texts)


def test_periods_and_runs(spark):
    rnd = random.Random(9)
    texts = ["a" * n for n in (399, 400, 401, 1500)] + ["ab" * 300, "ba" * 250, "abc" * 133 + "d", "abc" * 400, "Stüach. " * 120]
    texts += ["é" * 400, "x" + "é" * 300, ("q" * 350 + prose(rnd, 3)) * 4, ("only in here " + prose(rnd, 70)) * 2]
    texts += [prose(rnd, 30) + "-" * 500 + prose(rnd, 30) for _ in range(6)]
    check(spark, texts)


def test_ranks_decide(spark, monkeypatch):
    """Windows that differ in their core only are told apart by the ranks of doubling, and by nothing else."""
    rnd = random.Random(13)
    a, b = prose(rnd, 120)[:500], prose(rnd, 30)[:60]
    texts = [a[:220] + x + a[220:] for x in ("", b, b[:59] + "#", "#" + b[1:], b)]
    texts = [t[:500] + f" {k} " + prose(rnd, 20) for k, t in enumerate(texts)]
    check(spark, texts)
    reranked = suffix._reranked

    def unranked(state, step, n):
        if not step:
            return reranked(state, step, n)
        return state.select("region_id", "g", suffix.F.transform("r", lambda _: suffix.F.lit(0).cast("long")).alias("r"))

    monkeypatch.setattr(suffix, "_reranked", unranked)
    with pytest.raises(AssertionError):
        check(spark, texts)


def test_short_passages(spark):
    """51 words are found, whatever their length, at the pipeline's threshold."""
    rnd = random.Random(14)
    passages = [" ".join("".join(rnd.choices("abcdeéün", k=rnd.randint(3, 8))) for _ in range(51)) for _ in range(40)]
    assert min(len(p.encode()) for p in passages) >= 250
    texts = [prose(rnd, 60) + " " + p + " " + prose(rnd, rnd.randint(0, 60)) for p in passages for _ in range(2)]
    check(spark, texts, threshold=250)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(p not in r.text for r in suffix.without_repeats(docs, 250).collect() for p in passages)
    with pytest.raises(ValueError, match="below"):
        suffix.removals(docs, 191)


def mixed(rnd):
    """Passages shorter and longer than 400 bytes, near copies, copies of any length, periods, no text."""
    passages = ["".join(rnd.choices("abcdefgh ", k=n)) for n in (249, 250, 251, 320, 399, 400, 401, 700)]
    texts = [prose(rnd, rnd.choice([0, 5, 60])) + p + prose(rnd, rnd.choice([0, 40])) for p in passages for _ in range(3)]
    texts += [passages[-1][:300] + "#" + passages[-1][300:], prose(rnd, 20) + passages[3] + passages[5] + "!", passages[4], passages[4]]
    texts += ["ab" * 180, "ba" * 150, "x" * 260, "only here " + passages[3] + prose(rnd, 9) + passages[3][:270], None, "", "short", "short"]
    whole = prose(rnd, 200)
    return texts + [whole, whole, whole, whole[:450] + "?" + whole[450:], whole[100:420], prose(rnd, 200)]


@pytest.mark.parametrize("values", [1_000_000, 0])
def test_two_lengths(spark, monkeypatch, values):
    """What 400 bytes remove is as without the shorter length, which is exact too."""
    monkeypatch.setattr(suffix, "BROADCAST_VALUES", values)
    texts = mixed(random.Random(15))
    rows = [(k if k % 11 else None, t, k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_repeated long").repartition(4)
    got = suffix.removals(docs, T, 250)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"]
    want = [(r[0], *long, short[1]) for r, long, short in zip(rows, brute(texts), brute(texts, 250), strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    with pytest.raises(ValueError, match="no shorter"):
        suffix.removals(docs, 300, 300)
    assert suffix.removals(docs.limit(0), T, 250).count() == 0


def test_query_tells_short_passages(spark, tmp_path):
    """The query removes strings of 400 bytes; what passages of 51 words repeat, most of them shorter, it tells."""
    rnd = random.Random(16)
    passages = [" ".join("".join(rnd.choices("abcdeéün", k=rnd.randint(3, 8))) for _ in range(51)) for _ in range(20)]
    texts = [prose(rnd, 60) + " " + p + " " + prose(rnd, 40) for p in passages for _ in range(2)]
    clean = [prose(rnd, 120) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op8_suffix"](spark, str(tmp_path)).collect()}
    assert all(got[k].n_repeated >= len(passages[k // 2].encode()) for k in range(len(texts)))
    assert all(got[k].n_repeated == 0 for k in range(len(texts), len(got)))
    assert [tuple(got[k])[1:5] for k in range(len(got))] == brute(texts + clean)


def test_one_document_and_none(spark):
    rnd = random.Random(10)
    p = prose(rnd, 120)
    check(spark, [prose(rnd, 100) + p + prose(rnd, 300) + p + prose(rnd, 20)])
    check(spark, [prose(rnd, 100), prose(rnd, 100)])
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.removals(docs).count() == 0 == suffix.without_repeats(docs).count()


@pytest.mark.parametrize("size", [500, 1000])
def test_slices_and_small_steps_change_nothing(spark, monkeypatch, size):
    rnd = random.Random(11)
    p = [prose(rnd, 200) for _ in range(4)]
    texts = [prose(rnd, 30) + a + prose(rnd, 40) + b for a in p for b in p]
    want = brute(texts)
    monkeypatch.setattr(suffix, "SLICE", size)
    monkeypatch.setattr(suffix, "BROADCAST_VALUES", 0)
    found = suffix.anchors([t.encode() for t in texts])
    for k, t in enumerate(texts):
        own = found[0] == k
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(found[2][own], found[3][own], strict=True)])
        assert np.array_equal(starts, np.arange(len(t.encode()) - T + 1))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [tuple(r)[1:] for r in suffix.removals(docs).orderBy("doc_id").collect()] == want


def test_rest_keeps_rows_whole(spark):
    rnd = random.Random(12)
    p = prose(rnd, 120)
    texts = [prose(rnd, 80) + p + " end", "start " + p + prose(rnd, 80), prose(rnd, 90), None, ""]
    docs = spark.createDataFrame([(k, t, None if t is None else len(t), "s") for k, t in enumerate(texts)], "doc_id long, text string, n_chars long, Repeated string")
    kept = suffix.without_repeats(docs)
    assert kept.columns == docs.columns
    got = {r.doc_id: r for r in kept.collect()}
    for k in (2, 3, 4):
        assert got[k].text == texts[k]
    assert got[0].text.startswith(texts[0][:300]) and got[0].text.endswith(" end") and p not in got[0].text
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.values())


def test_tables_go_when_they_were_read(spark, monkeypatch):
    """Of the ranks two tables exist at most, and none of the windows' tables when the spans are joined."""
    stored, release, held, most = suffix.stored, shared.release, {}, {}

    def made(df, name):
        found = stored(df, name)
        held[found.stored_at] = name
        for n in held.values():
            most[n] = max(most.get(n, 0), list(held.values()).count(n))
        if name == "repeated":
            most["at the end"] = set(held.values())
        return found

    def gone(table):
        release(table)
        held.pop(getattr(table, "stored_at", None), None)

    monkeypatch.setattr(suffix, "stored", made)
    monkeypatch.setattr(suffix, "release", gone, raising=False)
    rnd = random.Random(29)
    p = prose(rnd, 150)
    check(spark, [prose(rnd, 40) + p + prose(rnd, n) for n in range(6)])
    assert most["ranks"] == 2 and not most["at the end"] & {"ranks", "cores", "regions", "twice"}
