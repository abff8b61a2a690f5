import hashlib
import random

import pytest

from chatterscope.llm import chunks, queries


def prose(rnd, n):
    return " ".join("".join(rnd.choices("abcdeéün", k=rnd.randint(1, 8))) for _ in range(n))


def slow_bounds(t):
    out, start, h = [], 0, 0
    for i, b in enumerate(t):
        h = ((h << 1) + int(chunks._GEAR[b])) & 0xFFFFFFFF
        n = i + 1 - start
        if len(t) - start <= chunks.LEAST:
            break
        if (n >= chunks.LEAST and h >> (32 - chunks.BITS) == 0) or n == chunks.MOST:
            out.append(i + 1)
            start = i + 1
    if start < len(t):
        out = [*out[:-1], len(t)] if out and len(t) - start <= chunks.LEAST else [*out, len(t)]
    return out


def test_bounds_equal_byte_by_byte():
    rnd = random.Random(2)
    texts = [prose(rnd, n).encode() for n in (0, 1, 8, 12, 90, 700)] + [b"a" * 1000, b"", b"xy" * 20, bytes(rnd.randbytes(4000)), b"q" * 32, b"q" * 33, b"q" * 290]
    assert chunks.bounds(texts) == [slow_bounds(t) for t in texts]


def test_an_insertion_changes_chunks_nearby_only():
    rnd = random.Random(4)
    t = prose(rnd, 3000).encode()
    sets = []
    for x in (t, t[:5000] + b" inserted words " + t[5000:]):
        ends = chunks.bounds([x])[0]
        sets.append({x[a:b] for a, b in zip([0, *ends], ends, strict=False)})
    assert len(sets[0] - sets[1]) <= 6 and len(sets[0]) > 100


def brute(rows):
    first_of, seen, out = {}, set(), {}
    order = sorted({(i is None, i or 0, t or "") for i, t in rows})
    for none, i, t in order:
        raw, key = t.encode(), (None if none else i, t)
        if t in first_of:
            out[key] = [(0, len(raw))] if len(raw) >= chunks.RUN else []
            continue
        first_of[t] = key
        ends = slow_bounds(raw)
        parts = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        again = []
        for k, p in enumerate(parts):
            if p in seen:
                again.append(k)
            seen.add(p)
        out[key] = chunks.runs([len(p) for p in parts], again, chunks.RUN)
    result = []
    for i, t in rows:
        raw, spans = (t or "").encode(), out[(i, t or "")]
        kept = chunks._cut(raw, spans)
        result.append((i, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(result, key=str)


@pytest.mark.parametrize("hot", [3, 50_000])
def test_equal_to_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(chunks, "HOT", hot)
    rnd = random.Random(6)
    passages = [prose(rnd, n) for n in (60, 80, 200)]
    texts = [prose(rnd, rnd.choice([2, 40, 300])) + rnd.choice([" ", rnd.choice(passages)]) + prose(rnd, rnd.choice([3, 60])) for _ in range(120)]
    texts += [texts[3], texts[3], texts[5], "tiny", "tiny", None, "", "-" * 3000, prose(rnd, 90) * 3]
    rows = [(k * 31 % 1009 if k % 19 else None, t) for k, t in enumerate(texts)] + [(31, texts[1]), (None, texts[3]), (5000, texts[0])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, chunk_fate string").repartition(4)
    # Rows without doc_id are told apart by their text only; keep those few unlike each other.
    got = sorted((tuple(r)[:5] for r in chunks.removals(docs).collect()), key=str)
    assert got == brute(rows)
    rest = {(r.doc_id, r.text) for r in chunks.without_duplicates(docs).select("doc_id", "text").collect()}
    assert (texts and (31, texts[1]) in rest) and chunks.without_duplicates(docs).columns == docs.columns
    assert chunks.removals(docs.limit(0)).count() == 0


def test_passages_over_fifty_words_are_found(spark):
    rnd = random.Random(7)
    found = either = 0
    docs = []
    for k in range(60):
        p = prose(rnd, 55)
        docs += [(2 * k, prose(rnd, 80) + " " + p + " " + prose(rnd, 30)), (2 * k + 1, prose(rnd, 50) + " " + p + " " + prose(rnd, 70))]
    clean = [(1000 + k, prose(rnd, 150)) for k in range(100)]
    for r in chunks.removals(spark.createDataFrame(docs + clean, "doc_id long, text string")).collect():
        if r.doc_id < 1000:
            found += r.n_removed > 0
            either += r.n_repeated > 0
            assert r.n_repeated >= r.n_removed
        else:
            assert r.n_removed == r.n_repeated == 0
    assert found == 60 and either == 2 * found


def test_every_passage_over_fifty_words_is_found_and_most_of_it(spark):
    rnd = random.Random(17)
    docs, size = [], 0
    for k in range(60):
        p = prose(rnd, 51)
        size += len(p.encode())
        docs += [(2 * k, prose(rnd, 80) + " " + p + " " + prose(rnd, 30)), (2 * k + 1, prose(rnd, 50) + " " + p + " " + prose(rnd, 70))]
    clean = [(1000 + k, prose(rnd, 150)) for k in range(100)]
    got = chunks.removals(spark.createDataFrame(docs + clean, "doc_id long, text string")).collect()
    found = [r.n_removed for r in got if r.doc_id < 1000 and r.n_removed > 0]
    assert len(found) == 60 and 0.75 * size < sum(found) <= size + 60 * 16
    assert all(r.n_repeated > 0 for r in got if r.doc_id < 1000) and not any(r.n_repeated for r in got if r.doc_id >= 1000)


def test_rows_without_doc_id_do_not_depend_on_the_layout(spark):
    rnd = random.Random(19)
    p = prose(rnd, 90)
    rows = [(None if k % 2 else 7, prose(rnd, 20) + " " + p + " " + prose(rnd, k)) for k in range(12)]
    found = []
    for parts, order in ((1, rows), (5, rows[::-1])):
        got = chunks.removals(spark.createDataFrame(order, "doc_id long, text string").repartition(parts)).collect()
        found.append(sorted(map(tuple, got), key=str))
    assert found[0] == found[1] and sum(r[2] == 0 for r in found[0]) == 1


def test_short_copies_go_as_a_whole(spark, tmp_path):
    texts = ["tiny", "tiny", "é", "é", "", "", None, "x" * 63, "x" * 63, "only once", "tiny"]
    docs = spark.createDataFrame([*enumerate(texts), (0, "tiny")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n_removed, r.n_spans, r.n_repeated) for r in queries.op1_chunks(spark, str(tmp_path)).collect()}
    sizes = [len((t or "").encode()) for t in texts]
    first = {t or "": k for k, t in reversed(list(enumerate(texts)))}
    want = set()
    for k, (t, n) in enumerate(zip(texts, sizes, strict=True)):
        later = n > 0 and first[t] != k
        want.add((k, n * later, int(later), n * (texts.count(t) > 1)))
    assert got == want
    rest = {r.doc_id: r.text for r in chunks.without_duplicates(docs, least_copy=1).collect()}
    assert [rest[k] for k in range(11)] == ["tiny", "", "é", "", "", "", "", "x" * 63, "", "only once", ""]


def moved(node):
    """Types of what the exchanges of a plan move."""
    if node.nodeName() == "Exchange":
        yield from (node.output().apply(i).dataType().simpleString() for i in range(node.output().size()))
    for i in range(node.children().size()):
        yield from moved(node.children().apply(i))


def test_lists_of_digests_do_not_move(spark, monkeypatch):
    """However large the tables are, so no join is by broadcast here."""
    types, stored = set(), chunks.stored

    def seen(df, name):
        plan = df._jdf.queryExecution().executedPlan()
        types.update(moved(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan))
        return stored(df, name)

    monkeypatch.setattr(chunks, "stored", seen)
    rnd = random.Random(23)
    p = prose(rnd, 70)
    docs = spark.createDataFrame([(k, prose(rnd, 30) + p) for k in range(20)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert all(r.n_repeated > 0 for r in chunks.removals(docs).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "bigint" in types and not [t for t in types if t.startswith("array") and "bigint" in t]
