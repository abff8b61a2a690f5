import hashlib
import random
from collections import Counter

import numpy as np

from chatterscope.llm import lines

WHITE = " \t\n\v\f\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(texts, least_docs=10, least_chars=1):
    split = [(t or "").split("\n") for t in texts]
    count = Counter(k for s in split for k in {key_of(x) for x in s})
    out = []
    for s in split:
        kept = [x for x in s if len(key_of(x)) < least_chars or count[key_of(x)] < least_docs]
        out.append((len(s), len(s) - len(kept), "\n".join(kept)))
    return out


def check(spark, texts, parts=6, **limits):
    rows = [(k if k % 11 else None, t, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Gone string").repartition(parts)
    got = sorted((tuple(r) for r in lines.removals(docs, **limits).collect()), key=str)
    want = brute(texts, **limits)
    assert got == sorted(((r[0], n, d, hashlib.sha256(k.encode()).hexdigest()) for r, (n, d, k) in zip(rows, want, strict=True)), key=str)
    kept = lines.without_lines(docs, **limits)
    assert kept.columns == docs.columns
    expected = [(r[0], t if t is None or d == 0 else k) for r, t, (_, d, k) in zip(rows, texts, want, strict=True)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(expected, key=str)


def test_lines_of_many_documents(spark):
    rnd = random.Random(1)
    common = ["All rights reserved.", "  ALL RIGHTS RESERVED.\t", "Été", "été", "x", " nbsp", "-- ", "\x1c"]
    texts = []
    for k in range(150):
        own = [f"line {k} {i}" for i in range(rnd.randint(0, 6))]
        texts.append("\n".join(rnd.sample(own + rnd.choices(common, k=3) + ["", " \r"], k=rnd.randint(1, len(own) + 3))))
    # Exactly nine and exactly ten documents; many times in one document only; copies; long; none.
    texts += ["nine\n" + str(k) for k in range(9)] + [f"{k}\r\nten\r" for k in range(10)] + ["alone\n" * 40] + ["same\ntext"] * 12
    texts += [None, "", "\n", "\n\n", " ", "x\n" * 5000 + "end", "y" * 200_000 + "\nx"]
    check(spark, texts)
    check(spark, texts, least_docs=2, least_chars=4)
    check(spark, texts, parts=1, least_docs=1)


def test_small_shards_and_blocks_change_nothing(spark, monkeypatch):
    rnd = random.Random(2)
    texts = ["\n".join(f"w{min(rnd.randint(0, 400), rnd.randint(0, 400))}" for _ in range(rnd.randint(1, 30))) for _ in range(400)]
    # The constants are read where a partition's rows are made, in other processes; so the parts are tested here.
    monkeypatch.setattr(lines, "SHARD", 7)
    check(spark, texts)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lines.removals(none).count() == 0 == lines.without_lines(none).count()


def test_perfect_hash():
    rnd = random.Random(3)
    for n in (1, 2, 100, 50_000):
        made = lines.packed(sorted({rnd.getrandbits(96) for _ in range(n)}))
        own = lines.Perfect.of(made)
        assert np.array_equal(np.sort(own.numbers(made)), np.arange(n))
        assert len(own.bits) * 8 <= max(64 * 8, 5 * n)
    # Keys with equal first or last parts are told apart.
    odd = lines.packed([5 << 32, (5 << 32) + 1, (6 << 32) + 1, (5 << 32) + 2])
    assert np.array_equal(np.sort(lines.Perfect.of(odd).numbers(odd)), np.arange(4))


def test_shards_answer_for_strangers():
    rnd = random.Random(4)
    made = lines.packed(sorted({rnd.getrandbits(96) for _ in range(3000)}))
    own = lines.Perfect.of(made)
    at = own.numbers(made)
    fingerprints, counts = np.empty(len(made), "<u4"), np.empty(len(made), "<u2")
    fingerprints[at], counts[at] = made["f"], np.arange(len(made)) % 500 + 1
    shard = lines.Shard(own.bits.tobytes(), own.levels, fingerprints.tobytes(), counts.tobytes(), 2)
    assert np.array_equal(shard.probe(made), np.arange(len(made)) % 500 + 1)
    assert not shard.probe(lines.packed(sorted({rnd.getrandbits(96) for _ in range(3000)}))).any()


def test_ranges_of_shards_agree_with_spark(spark):
    from pyspark.sql import functions as F

    h = np.random.default_rng(5).integers(0, 1 << 63, 200, np.uint64) * np.uint64(2) + np.uint64(1)
    df = spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long")
    got = [r.s for r in df.select(F.shiftright(F.shiftrightunsigned("h", 32) * F.lit(13), 32).alias("s")).collect()]
    assert got == lines.shard_of(h, 13).tolist()
