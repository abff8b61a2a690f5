import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chatterscope.llm import align
from chatterscope.llm.bpe import byte_symbols

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
EDGES = [
    None, "", " ", "  ", "a", " a", "a ", "  a  b ", "a\n b", "\n", "a\n\n  b\t c \r\n d", "x y   z", "a▁b", "▁", "\x00 \x1c b",
    "<|endoftext|> <s> </s><unk> <0x0A>", "éé ﬁ ½", "\U0001f600\U0001f600 \U0001f468‍\U0001f469", "你好 世界", "don't we'll I'M", "3,000 12345678", "{\r\n\t};\r",
    "a" * 3000, " " * 50 + "x" + " " * 33, "  　 q",
]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, tokenizers):
    """The contract, byte by byte, with whole texts given to the libraries."""
    a, b = tokenizers
    spelled = {s: i for i, s in enumerate(byte_symbols())}
    pieces = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw_a, raw_b = [bytes(spelled[c] for c in a.id_to_token(i)) for i in ids_a], [pieces(i) for i in ids_b]
        if not t or not b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
            found.append(([], [], [], ""))
            continue
        owner_a, owner_b = ([k for k, r in enumerate(x) for _ in r] for x in (raw_a, raw_b))
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        n = len(owner_a)
        cuts = [p for p in range(1, n + 1) if p == n or (owner_a[p] != owner_a[p - 1] and owner_b[p] != owner_b[p - 1])]
        groups, at = [], 0
        for c in cuts:
            x, y = (",".join(str(ids[k]) for k in dict.fromkeys(owner[at:c])) for ids, owner in ((ids_a, owner_a), (ids_b, owner_b)))
            groups.append((at, c, f"{x}|{y}"))
            at = c
        found.append((ids_a, ids_b, [(ids_a[x], ids_b[y]) for x, y in links], groups))
    count = Counter(p for f in found for p in f[2])
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    rows = []
    for ids_a, ids_b, links, groups in found:
        text = ";".join(g[2] for g in groups)
        best = sum(count[p] == most[p[1]] for p in links)
        rows.append((len(ids_a), len(ids_b), len(groups), len(links), best, sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if ids_a else ""))
    return rows, count, most, [f[3] or [] for f in found]


def check(spark, texts, tokenizers):
    rows = [(k if k % 9 else None, t, "x", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, Block int").repartition(5)
    got = sorted((tuple(r) for r in align.alignments(docs, A, B).collect()), key=str)
    want, count, most, groups = brute(texts, tokenizers)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=str)
    assert got and max(len(r) for r in got) == 8
    return docs, count, most, groups


def test_edges_and_documents(spark, tokenizers):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [*EDGES, texts[0], texts[0], "a", " ".join(texts[:40])]
    docs, count, most, groups = check(spark, texts, tokenizers)
    pairs = {(r.a, r.b): (r.n, r.best) for r in align.pair_counts(docs, A, B).collect()}
    assert pairs == {p: (n, n == most[p[1]]) for p, n in count.items()}
    got = sorted(str([(g.start, g.end, ",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b))) for g in r.groups]) for r in align.groups(docs, A, B).collect())
    assert got == sorted(str(g) for g in groups)


def test_blocks_lanes_memory_and_hot_pairs_change_nothing(spark, tokenizers, monkeypatch):
    rnd = random.Random(4)
    texts = ["the " + "".join(rnd.choices("ab é世.\n1", k=rnd.randint(0, 300))) for _ in range(120)] + EDGES
    # One partition in this process's place: the constants are read where the rows are made.
    own = align.Coders(A, B)
    want = align.Aligned(own, [t or "" for t in texts])
    monkeypatch.setattr(align, "LANE", 3)
    small = align.Coders(A, B, remembered=20)
    for _ in range(3):
        got = align.Aligned(small, [t or "" for t in texts])
        for name in ("a", "b", "link_a", "link_b", "cut_a", "cut_b", "first_link", "first_cut"):
            assert (getattr(got, name) == getattr(want, name)).all(), name
    monkeypatch.setattr(align, "HOT", 10)
    monkeypatch.setattr(align, "BLOCK_BYTES", 1000)
    check(spark, texts, tokenizers)


def test_no_rows_and_no_tokens(spark, tokenizers):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.alignments(none, A, B).count() == 0 == align.pair_counts(none, A, B).count()
    check(spark, [None, "", "a▁"], tokenizers)


def test_library_gives_stretches_like_whole_texts(spark, tokenizers):
    a, b = tokenizers
    own = align.Coders(A, B)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("text").isNotNull()).select("text").collect()]
    x = align.Aligned(own, texts)
    for k, (ids_a, ids_b) in enumerate(zip(a.encode_batch([" " + t for t in texts], add_special_tokens=False), b.encode(texts), strict=True)):
        if x.first_a[k] < x.first_a[k + 1]:
            assert x.a[x.first_a[k] : x.first_a[k + 1]].tolist() == ids_a.ids and x.b[x.first_b[k] : x.first_b[k + 1]].tolist() == ids_b
