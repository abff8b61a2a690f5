import hashlib
import random

import pytest

from chatterscope.llm import exact
from chatterscope.llm.queries import ORACLE


def want(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for i, text in rows:
        ids = groups[text or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def make_rows():
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "b ", "B", "", None, "x" * 5000, "é", "e\u0301"]) if i % 3 else f"own {i} " * rnd.randint(1, 30)) for i in range(600)]
    return rows + [(7, rows[7][1]), (None, "a"), (None, "only null"), (None, "only null"), (601, "z" * 300_000)]


@pytest.mark.parametrize("bucket_bytes", [1, 20_000, exact.BUCKET_BYTES])
def test_equal_to_brute_force(spark, bucket_bytes):
    rows = make_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, dedup string").repartition(6)
    got = exact.deduplicate(docs, bucket_bytes).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in rows}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_distinct_keeps_rows_whole(spark):
    rows = make_rows()
    docs = spark.createDataFrame([(*r, f"s{k}") for k, r in enumerate(rows)], "doc_id long, text string, Dedup string").repartition(4)
    kept = exact.distinct(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == len({t or "" for _, t in rows}) and set(got) <= {tuple(r) for r in docs.collect()}
    assert exact.distinct(docs.limit(0)).count() == 0 == exact.deduplicate(docs.limit(0)).count()


def test_equal_hashes_are_told_apart():
    table = exact.Table(4)
    places = [table.find(5, c) for c in (b"a", b"b", b"a", b"c", b"b", b"d", b"e")]
    assert places == [(0, True), (1, True), (0, False), (2, True), (1, False), (3, True), (4, True)]


def test_full_task_tables_change_nothing(spark, monkeypatch):
    rows = make_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(exact, "TASK_BYTES", 1)
    got = exact.deduplicate(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want(rows)


def test_sql_is_registered():
    assert "op4_exact" in ORACLE
