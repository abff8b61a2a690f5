"""Alignment of two tokenizers' tokens by lockstep merging.

Both tokenizers cut the same bytes. One pointer for each walks along a text's tokens: the pair under the
pointers overlaps and is a link; the token that ends first gives way to its successor, and where both end
at one byte there is a cut, which closes a group. All documents of a block advance at once: the pointers
are one numpy state vector, each step emits a link for every entry, and a cut for those at a common end,
and finished entries are squeezed out. A text of many tokens enters as several lanes, begun where both
tokenizers start anew, so that the number of steps follows a lane's length, not that of the longest text.

Texts are encoded in stretches that begin at a space after something else. No token of either vocabulary
reaches over such a place (`Coders` checks that of the second), and stretches are remembered.

Link counts need the whole corpus. Documents are dealt to blocks of bounded bytes; a block names its
distinct id pairs once and its links by their number. Pair counts are summed in Spark, brought back to the
blocks that hold the pair, and each block is finished on its own. Pairs that more than one in `HOT` of all
block entries belong to are fewer than `HOT`; they are joined by broadcast, the others by key.

Texts that are null or empty, or that one of the tokenizers does not give back byte for byte, have no
tokens: zeros and an empty digest. Null doc_ids and repeated rows are rows like any other and count each
time; a text of any length is handled whole, as a block of its own if need be; equal counts share the
highest rank. Extra columns are ignored, no rows give no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterscope.llm.bpe import WHITE, byte_symbols
from chatterscope.llm.shared import stored

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 22
#: Tokens of both kinds after which a text goes on in another lane.
LANE = 512
#: Bound on the number of pairs that are joined by broadcast.
HOT = 50_000
#: Remembered stretches in a worker; a full memory is emptied, which costs time only.
REMEMBERED = 500_000

MARK = "\N{LOWER ONE EIGHTH BLOCK}"
#: Fixed value: the pattern by which byte-level tokenizers of this kind split text.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


class Table:
    """Token ids of the stretches met so far, in flat arrays."""

    def __init__(self):
        self.ids, self.first, self.n = np.zeros(1 << 16, np.int32), np.zeros(1, np.int64), 0

    def add(self, lists: list[list[int]]) -> None:
        flat = np.fromiter((i for x in lists for i in x), np.int32)
        if self.n + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n], np.zeros(len(self.ids) + len(flat), np.int32)])
        self.ids[self.n : self.n + len(flat)] = flat
        self.n += len(flat)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the stretches `codes`, one after the other; how many each has)."""
        first, size = self.first[codes], self.first[codes + 1] - self.first[codes]
        begin = np.cumsum(size) - size
        return self.ids[np.repeat(first - begin, size) + np.arange(int(size.sum()))], size


class Coders:
    """Both tokenizers over stretches of space+text."""

    def __init__(self, path_a: str, path_b: str, remembered: int = REMEMBERED):
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        spelled = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"]}
        entries = {bytes(spelled[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.a = tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks=entries, special_tokens={})
        self.bytes_a = {i: b for b, i in entries.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece reaches over a space: texts of this vocabulary can't be encoded in stretches")
        self.bytes_b = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE_PIECE.fullmatch(p)) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.lone = self.b.piece_to_id(MARK)
        self.size_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.size_a[list(self.bytes_a)] = [len(b) for b in self.bytes_a.values()]
        self.size_b = np.array([len(b) for b in self.bytes_b])
        self.split = re.compile(f" [^ ]*(?:(?<=[ {re.escape(WHITE)}\x1c-\x1f]) [^ ]*)*").findall
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table_a, self.table_b, self.same = Table(), Table(), np.zeros(0, bool)

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of every stretch, how many each text has). Valid until the next call."""
        if len(self.known) > self.remembered:
            self._forget()
        found = [self.split(" " + t) if t else [] for t in texts]
        known = self.known
        new = list(dict.fromkeys(s for x in found for s in x if s not in known))
        if new:
            ids_a = [self.a.encode_ordinary(s) for s in new]
            # The library puts a space before what it gets; of a space alone it makes nothing.
            ids_b = [ids if s != " " else [self.lone] for s, ids in zip(new, self.b.encode([s[1:] for s in new], num_threads=1), strict=True)]
            raw = [s.encode() for s in new]
            same_a = [b"".join([self.bytes_a[i] for i in x]) == s for x, s in zip(ids_a, raw, strict=True)]
            same_b = [b"".join([self.bytes_b[i] for i in x]) == s for x, s in zip(ids_b, raw, strict=True)]
            self.table_a.add(ids_a)
            self.table_b.add(ids_b)
            self.same = np.concatenate([self.same, np.array(same_a) & np.array(same_b)])
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((known[s] for x in found for s in x), np.int64, int(sizes.sum())), sizes


_coders: dict[tuple[str, str], Coders] = {}


def coders(path_a: str, path_b: str) -> Coders:
    """One pair of tokenizers in a Python worker, kept between its tasks."""
    if (path_a, path_b) not in _coders:
        _coders[path_a, path_b] = Coders(path_a, path_b)
    return _coders[path_a, path_b]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, lane_a: np.ndarray, lane_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(links' A and B tokens, cuts' A and B tokens), in order of the bytes.

    end_a, end_b: where each token ends, over all lanes' bytes laid end to end. lane_a, lane_b: the first
    token of each lane, and at last the number of tokens. Lanes begin and end at common ends.
    """
    lane_a, lane_b = np.asarray(lane_a), np.asarray(lane_b)
    link_b = np.full(len(end_a) + len(end_b), -1, np.int64)  # by the sum of both numbers, which grows along a text
    cut_b = np.full(len(end_a), -1, np.int64)
    open_ = lane_a[1:] > lane_a[:-1]
    i, j, last = lane_a[:-1][open_], lane_b[:-1][open_], lane_a[1:][open_]
    while len(i):
        link_b[i + j] = j
        a, b = end_a[i], end_b[j]
        both = a == b
        cut_b[i[both]] = j[both]
        i, j = i + (a <= b), j + (b <= a)
        done = i == last
        if done.any():
            i, j, last = i[~done], j[~done], last[~done]
    at = np.flatnonzero(link_b >= 0)
    cut = np.flatnonzero(cut_b >= 0)
    return at - link_b[at], link_b[at], cut, cut_b[cut]


class Aligned:
    """The tokens, links and cuts of a block's texts; those without tokens have none."""

    def __init__(self, own: Coders, texts: list[str]):
        codes, sizes = own.codes(texts)
        text = np.repeat(np.arange(len(texts)), sizes)
        whole = np.bincount(text, weights=~own.same[codes], minlength=len(texts)) == 0 if len(codes) else np.ones(len(texts), bool)
        codes, text = codes[whole[text]], text[whole[text]]
        self.a, n_a = own.table_a.of(codes)
        self.b, n_b = own.table_b.of(codes)
        # How many tokens the texts before have, and at last all.
        self.first_a = np.concatenate([[0], np.cumsum(np.bincount(text, weights=n_a, minlength=len(texts)))]).astype(np.int64)
        self.first_b = np.concatenate([[0], np.cumsum(np.bincount(text, weights=n_b, minlength=len(texts)))]).astype(np.int64)
        before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        lane = (before_a + before_b - self.first_a[text] - self.first_b[text]) // LANE
        begins = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(lane, prepend=-1) != 0))
        self.end_a, self.end_b = np.cumsum(own.size_a[self.a]), np.cumsum(own.size_b[self.b])
        lanes = np.append(before_a[begins], len(self.a)), np.append(before_b[begins], len(self.b))
        self.link_a, self.link_b, self.cut_a, self.cut_b = lockstep(self.end_a, self.end_b, *lanes)
        self.first_link = np.searchsorted(self.link_a, self.first_a)
        self.first_cut = np.searchsorted(self.cut_a, self.first_a)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """(place in the groups' list of every A token, of every B token): a group's A tokens, then its B."""
        g_a = np.searchsorted(self.cut_a, np.arange(len(self.a)))
        g_b = np.searchsorted(self.cut_b, np.arange(len(self.b)))
        b_before = np.concatenate([[0], self.cut_b + 1])
        a_through = self.cut_a + 1
        return np.arange(len(self.a)) + b_before[g_a], np.arange(len(self.b)) + a_through[g_b] if len(self.b) else g_b

    def digests(self, table: pa.Array) -> list[str]:
        """SHA-256 of each text's groups, `a1,a2|b1;a3|b2`; '' for texts without tokens."""
        n = len(table) // 3  # each number followed by `,`, then by `|`, then by `;`
        kind_a, kind_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        kind_a[self.cut_a], kind_b[self.cut_b] = 1, 2
        at_a, at_b = self.merged()
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[at_a], order[at_b] = self.a + n * kind_a, self.b + n * kind_b
        taken = table.take(pa.array(order))
        offsets, raw = np.frombuffer(taken.buffers()[1], np.int64)[: len(order) + 1], memoryview(taken.buffers()[2] or b"")
        ends = offsets[self.first_a + self.first_b].tolist()
        return [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _numbers(n: int) -> pa.Array:
    return pa.array([f"{i}{mark}" for mark in ",|;" for i in range(n)], pa.large_string())


def blocks(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `limit` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False) + 16
    owner = (np.cumsum(sizes) - sizes) // limit
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    return zip(first.tolist(), [*first[1:].tolist(), len(sizes)], strict=True)


_LINKED = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
     ("groups_sha256", pa.string()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document: its block, counts, digest and links, as numbers of the block's pairs. The
    first row of a block lists its pairs (A id * 2^32 + B id) and how many links hold each. To be stored."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made = coders(path_a, path_b), 0
        table = _numbers(max(len(own.size_a), len(own.size_b)))
        for batch in batches:
            for first, last in blocks(batch, BLOCK_BYTES):
                part = batch.slice(first, last - first)
                found = Aligned(own, [t or "" for t in part.column("text").to_pylist()])
                pair = (found.a[found.link_a].astype(np.int64) << 32) | found.b[found.link_b]
                number, pairs = pd.factorize(pair)
                counts = np.bincount(number, minlength=len(pairs))
                raw = number.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
                raw, width = raw.tobytes(), raw.itemsize
                n = last - first
                at = found.first_link * width
                per = [np.diff(x) for x in (found.first_a, found.first_b, found.first_cut, found.first_link)]
                block = (TaskContext.get().partitionId() << 33) | made
                made += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, block)), part.column("doc_id"), *(pa.array(x, pa.int64()) for x in per),
                        pa.array(found.digests(table), pa.string()), pa.array([raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                        *(pa.array([x, *[None] * (n - 1)], pa.list_(pa.int64())) for x in (pairs, counts)),
                    ],
                    schema=_LINKED,
                )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    types = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<long>, counts array<long>"
    return read.mapInArrow(link, types)


def _entries(rows: DataFrame) -> DataFrame:
    """(block, k, pair, n): a block's k-th pair and how many of its links hold it."""
    listed = rows.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("k", "x"))
    return listed.select("block", "k", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))


def _counted(rows: DataFrame) -> DataFrame:
    """(pair, n, blocks, best) over the whole corpus; best: no other pair of its B id has more links."""
    counts = _entries(rows).groupBy("pair").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"))
    counts = stored(counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pairs")
    # At most a row for each entry of the B vocabulary.
    most = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("most")))
    return counts.join(most, "b").select("pair", "n", "blocks", (F.col("n") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """a, b, n and best of every id pair that some link holds."""
    found = _counted(stored(linked(docs, path_a, path_b), "linked"))
    return found.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n", "best")


def _sums(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's documents with what their links count."""
    size = counts.num_rows
    n, best = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    k = counts.column("k").to_numpy()
    n[k], best[k] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
    raw = docs.column("links").to_pylist()
    number = np.frombuffer(b"".join(raw), "<u2" if size <= 1 << 16 else "<u4")
    at = np.concatenate([[0], np.cumsum(docs.column("n_links").to_numpy())])
    total = [np.concatenate([[0], np.cumsum(x[number])]) for x in (best, n)]
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    for name, x in zip(("n_best", "count_sum"), total, strict=True):
        out = out.append_column(name, pa.array(x[at[1:]] - x[at[:-1]], pa.int64()))
    return out.select(_OUT)


_OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
_OUT_TYPES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    rows = stored(linked(docs, path_a, path_b), "linked")
    counts, entries = stored(_counted(rows), "counts"), _entries(rows).drop("n")
    total = counts.agg(F.sum("blocks")).first()[0] or 0
    # sum(blocks) = total, so fewer than HOT pairs are in more than total / HOT blocks.
    hot = counts.where(F.col("blocks") > total // HOT + 1).drop("blocks")
    rest = counts.where(F.col("blocks") <= total // HOT + 1).drop("blocks")
    back = entries.join(F.broadcast(hot), "pair").unionByName(entries.join(rest.hint("merge"), "pair")).select(F.col("block").alias("of"), "k", "n", "best")
    own = rows.drop("pairs", "counts")
    return own.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_sums, _OUT_TYPES)


_GROUPS = "doc_id long, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>"
_GROUP = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id and the groups of every row: first and last byte (exclusive) in space+text, A ids and B ids."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coders(path_a, path_b)
        for batch in batches:
            for first, last in blocks(batch, BLOCK_BYTES):
                part = batch.slice(first, last - first)
                x = Aligned(own, [t or "" for t in part.column("text").to_pylist()])
                start = np.concatenate([[0], x.end_a[x.cut_a]])
                shift = np.repeat(start[x.first_cut[:-1]], np.diff(x.first_cut))
                offsets = lambda cut: pa.array(np.concatenate([[0], cut + 1]).astype(np.int32))
                fields = [
                    pa.array(start[:-1] - shift), pa.array(start[1:] - shift),
                    pa.ListArray.from_arrays(offsets(x.cut_a), pa.array(x.a)), pa.ListArray.from_arrays(offsets(x.cut_b), pa.array(x.b)),
                ]
                listed = pa.ListArray.from_arrays(pa.array(x.first_cut.astype(np.int32)), pa.StructArray.from_arrays(fields, names=["start", "end", "a", "b"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), listed.cast(_GROUP)], names=["doc_id", "groups"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(group, _GROUPS)
