import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from test_minhash import brute as components
from test_suffix import prose
from tokenizers import Tokenizer

import corpus_pipeline

T = corpus_pipeline.REPEATED
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def corpus():
    rnd = random.Random(21)
    passages = [prose(rnd, 100), prose(rnd, 160)]
    rows = []
    for k in range(160):
        text = prose(rnd, rnd.choice([20, 120, 400]))
        if k % 5 == 0:
            text += " " + rnd.choice(passages) + " " + prose(rnd, 40)
        rows.append([k, text, "xx"])
    for k in range(160, 200):  # exact and near copies
        words = rnd.choice(rows[:30])[1].split(" ")
        if k % 2:
            words[rnd.randrange(len(words))] = "changed"
        rows.append([k, " ".join(words), "xx"])
    rows += [[300, None, "xx"], [301, "", "xx"], [302, "12 34 !!", None], [303, rows[3][1], "xx"], [None, prose(rnd, 50), None], [3, rows[3][1], "xx"]]
    return [(*r, f"src{k % 3}", None if r[1] is None else len(r[1]), f"extra{k}") for k, r in enumerate(rows)]


def test_stages_equal_brute_force(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, Node string"
    rows = corpus()
    docs = spark.createDataFrame(rows, schema).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact_copies", "near_copies", "repeats", "sequences"]

    kept = stages["language"](spark, docs, "")
    want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert kept.columns == docs.columns and Counter(map(tuple, kept.collect())) == Counter(want)

    docs = stages["exact_copies"](spark, kept, "")
    largest = {}
    for r in want:
        if r[1] not in largest or (r[0] is not None and (largest[r[1]][0] or -1) < r[0]):
            largest[r[1]] = r
    got = [tuple(r) for r in docs.collect()]
    assert docs.columns == kept.columns and sorted((r[0], r[1]) for r in got if r[0] is not None) == sorted((r[0], r[1]) for r in largest.values() if r[0] is not None)
    assert len(got) == len(largest) and set(got) <= set(rows)

    docs = stages["near_copies"](spark, docs, "")
    marked = components([(r[0], r[1]) for r in got], corpus_pipeline.NEAR)
    want = {r for r, m in zip(got, marked, strict=True) if m[3]}
    near = [tuple(r) for r in docs.collect()]
    assert docs.columns == kept.columns and set(near) == want and len(near) == len(want) < len(got)

    docs = stages["repeats"](spark, docs, "")
    seen = Counter(t[i : i + T] for r in near for t in [r[1].encode()] for i in range(len(t) - T + 1))
    want = {}
    for r in near:
        raw = r[1].encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - T + 1):
            if seen[raw[i : i + T]] > 1:
                gone[i : i + T] = True
        text = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
        want[r[0]] = (text, len(text))
    rest = docs.collect()
    assert docs.columns == kept.columns and {r.doc_id: (r.text, r.n_chars) for r in rest} == want and len(rest) == len(near)
    assert any(r.n_chars < len(n[1]) for r in rest for n in near if n[0] == r.doc_id)

    pieces = stages["sequences"](spark, docs, "").collect()
    length, sequences = Counter(), defaultdict(list)
    for p in pieces:
        length[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    assert length == {r.doc_id: len(LIBRARY.encode(r.text, add_special_tokens=False).ids) + 1 for r in rest}
    for places in sequences.values():
        ends = np.cumsum([0] + [n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_equals_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))
    assert got.count() > 0
