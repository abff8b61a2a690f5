"""Packing of whole documents into sequences of a fixed length.

Documents become ids, longer ones are cut, and the pieces' lengths are counted. From the histogram
alone the driver plans: it enumerates patterns of up to three lengths that fill a sequence, fits their
repeat counts to the histogram by non-negative least squares, rounds them down, and packs what is left
best-fit, longest first, into new sequences and into room that the patterns left. Patterns of bins may
leave room that no residual fits, so the plan is made with several shares of the repeat counts, and the one
of fewest sequences stands; a share of zero is best-fit decreasing of everything, so no plan is worse than
that. The plan holds counts
of lengths, never pieces, so its size follows the number of lengths. Each piece then finds its place
from its length and its rank among the pieces of that length; ranks come from a running number in each
task and a sum over tasks, so that no task sees all pieces of a common length.

A null text is empty and gives one piece, the closing id. Null doc_ids are kept as null, repeated rows
are packed one by one, pieces of equal length are interchangeable and take the places of that length by
their rank, extra columns are ignored, no rows give no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterscope.llm.bpe import WHITE, byte_symbols
from chatterscope.llm.shared import stored, text_of

SIZE = 2048
#: Width of the bins of lengths that patterns are made of.
BIN = 16
#: Shares of the fitted repeat counts that plans are made with.
SHARES = (1.0, 0.98, 0.95, 0.9, 0.8, 0.65, 0.5, 0.25, 0.0)
#: Remembered runs in a worker; a full memory is emptied, which costs time only.
REMEMBERED = 600_000
#: Fixed value: the pattern by which byte-level tokenizers of this kind split text.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Ids:
    """Ids of whole texts as little-endian 32-bit bytes, those that the tokenizers library gives.

    The file's ids are ranks of its merges, so the tiktoken library, which is faster on short strings,
    encodes with the same vocabulary. No token of a byte-level vocabulary reaches from other characters
    over to white space after them, so a text is encoded in runs of white space and what follows, which
    are remembered.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spelled = {s: b for b, s in enumerate(byte_symbols())}
        self.encoding = tiktoken.Encoding(
            "file",
            pat_str=_WORDS,
            mergeable_ranks={bytes(spelled[c] for c in s): i for s, i in spec["model"]["vocab"].items()},
            special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]},
        )
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.runs: dict[str, bytes] = {}
        self.remembered = remembered
        white = re.escape(WHITE)
        self.split = re.compile(f"[{white}]*[^{white}]+|[{white}]+").findall

    def _run(self, run: str) -> bytes:
        ids = self.encoding.encode(run, allowed_special="all") if self.special.search(run) else self.encoding.encode_ordinary(run)
        if len(self.runs) >= self.remembered:
            self.runs.clear()
        found = self.runs[run] = np.array(ids, "<u4").tobytes()
        return found

    def of(self, text: str) -> bytes:
        known = self.runs.get
        return b"".join([known(run) or self._run(run) for run in self.split(text)])


_ids: dict[str, Ids] = {}


def ids_for(path: str) -> Ids:
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than `size`."""
    first = n % size
    starts = ([0] if first else []) + list(range(first, n, size))
    return list(zip(starts, np.diff([*starts, n]).tolist(), strict=True))


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """`(doc_id, piece, start, length, ids_crc32)` and, to rank pieces of one length, the writing task
    and a running number of that length in it. To be stored before use."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, seen = ids_for(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_of(batch, "text"), strict=True):
                raw = ids.of(text) + b"\0\0\0\0"
                for k, (start, length) in enumerate(cut(len(raw) // 4, size)):
                    crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                    rows.append((doc_id, k, start, length, crc, part, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES
            ) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in _TYPES], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, _PIECES)


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def patterns(bins: int) -> list[tuple[int, ...]]:
    """Up to three bins, largest first, that together are all bins."""
    found: list[tuple[int, ...]] = [(bins,)]
    for a in range(bins - 1, 0, -1):
        for b in range(min(a, bins - a), 0, -1):
            c = bins - a - b
            if c == 0:
                found.append((a, b))
            elif c <= b:
                found.append((a, b, c))
    return found


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 of least |a x - b|: columns join while they lower the rest, and leave at zero."""
    gram, target = a.T @ a, a.T @ b
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(3 * a.shape[1]):
        gain = np.where(free, -np.inf, target - gram @ x)
        if gain.max(initial=-np.inf) <= tolerance:
            break
        free[int(gain.argmax())] = True
        while True:
            at = np.flatnonzero(free)
            s = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            falling = s <= 0
            old = x[at]
            step = (old[falling] / (old[falling] - s[falling])).min()
            x[at] = old + step * (s - old)
            gone = at[falling & (x[at] <= 1e-12 * max(1.0, old.max(initial=0)))]
            x[gone] = 0
            free[gone] = False
            if not free.any():
                break
    return x


def plan(histogram: dict[int, int], size: int = SIZE, width: int = BIN) -> list[tuple[tuple[int, ...], int]]:
    """Groups of equal sequences: (lengths in them, how many), which hold the histogram exactly."""
    left = {n: c for n, c in histogram.items() if c > 0}
    groups: list[tuple[tuple[int, ...], int]] = []
    if left.get(size):
        groups.append(((size,), left.pop(size)))
    if not left:
        return groups
    lengths = sorted(left)
    bins = -(-size // width)
    count = np.zeros(bins + 1)
    by_bin: dict[int, list[int]] = defaultdict(list)
    for n in lengths:
        count[-(-n // width)] += left[n]
        by_bin[-(-n // width)].append(n)
    # A pattern of which some bin has no piece would repeat zero times after rounding.
    usable = [p for p in patterns(bins) if all(count[k] for k in p)]
    repeats = np.zeros(len(usable))
    if usable:
        matrix = np.zeros((bins + 1, len(usable)))
        for j, p in enumerate(usable):
            for k in p:
                matrix[k, j] += 1
        repeats = least_squares(matrix, count)
    plans = []
    for share in SHARES if repeats.any() else SHARES[-1:]:
        rest, made = dict(left), list(groups)
        for j in np.argsort(-repeats):
            made += _instances(usable[j], int(share * repeats[j]), rest, by_bin, size, width)
        plans.append(_best_fit(made, rest, size))
    # Of plans with equally many sequences the first, with the largest share of patterns.
    return min(plans, key=lambda groups: sum(times for _, times in groups))


def _instances(pattern, repeats, left, by_bin, size, width):
    """Sequences of one pattern with actual lengths: the longest of each bin, and for the last place
    the longest that fits, which makes up for the bins' width."""
    made = []
    while repeats > 0:
        need: Counter = Counter()
        chosen = []
        for place, k in enumerate(pattern):
            room = size - sum(chosen)
            last = place and place == len(pattern) - 1
            near = range(min(room // width + 1, size // width + 1), k - 1, -1) if last else (k,)
            pick = next((n for b in near for n in reversed(by_bin.get(b, ())) if n <= room and left.get(n, 0) > need[n]), None)
            if pick is None:
                return made
            chosen.append(pick)
            need[pick] += 1
        times = min(repeats, *(left[n] // c for n, c in need.items()))
        for n, c in need.items():
            left[n] -= c * times
        repeats -= times
        made.append((tuple(chosen), times))
    return made


def _best_fit(groups, left, size):
    """What is left goes, longest first, where the least room remains, else to new sequences."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for lengths, times in groups:
        by_room[size - sum(lengths)].append((lengths, times))
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        todo = left[n]
        for room in sorted(r for r in by_room if r >= n and by_room[r]):
            while todo and by_room[room]:
                lengths, times = by_room[room].pop()
                fits = room // n
                if times >= -(-todo // fits):  # one group takes the rest
                    full, some = divmod(todo, fits)
                    rest = times - full - (some > 0)
                    for k, c in ((fits, full), (some, 1 if some else 0), (0, rest)):
                        if c:
                            by_room[room - k * n].append((lengths + (n,) * k, c))
                    todo = 0
                else:
                    by_room[room - fits * n].append((lengths + (n,) * fits, times))
                    todo -= fits * times
            if not todo:
                break
        if todo:
            fits = size // n
            full, some = divmod(todo, fits)
            for k, c in ((fits, full), (some, 1 if some else 0)):
                if c:
                    by_room[size - k * n].append(((n,) * k, c))
    return [g for room in sorted(by_room) for g in by_room[room]]


class Places:
    """Where the piece of some length and rank goes."""

    def __init__(self, groups: list[tuple[tuple[int, ...], int]]):
        taken: Counter = Counter()
        rows, base = [], 0
        for lengths, times in groups:
            offset = 0
            for n in lengths:
                rows.append((n, taken[n], base, offset))
                taken[n] += times
                offset += n
            base += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.lengths, self.ranks, self.base, self.offset = np.ascontiguousarray(table.T)
        self.bounds = {int(n): slice(*np.searchsorted(self.lengths, [n, n + 1])) for n in np.unique(self.lengths)}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
        for n in np.unique(lengths):
            own, at = lengths == n, self.bounds[int(n)]
            k = at.start + np.searchsorted(self.ranks[at], ranks[own], "right") - 1
            sequence[own] = self.base[k] + ranks[own] - self.ranks[k]
            offset[own] = self.offset[k]
        return sequence, offset


def pack(docs: DataFrame, path: str, size: int = SIZE, width: int = BIN) -> DataFrame:
    """Every piece with its sequence and offset there. `path`: the vocabulary file, on all executors.

    The driver receives the histogram of lengths, at most `size` rows.
    """
    cut_up = stored(pieces(docs, path, size), "pieces")
    counts = cut_up.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places(plan(histogram, size, width))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = [batch.column(c) for c in _NAMES[:5]]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], names=[*_NAMES[:5], "sequence_id", "offset"]
            )

    ranked = cut_up.join(before, ["part", "length"]).select(*_NAMES[:5], (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, _PLACED)
