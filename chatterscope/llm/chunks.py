"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's bytes: each step shifts the hash and adds a random number of the byte, so
it depends on the last 16 bytes only. Where its highest bits are zero a chunk ends, unless it is shorter
than `LEAST`; it ends at `MOST` bytes in any case, and a short end joins the chunk before. Bounds depend
on nearby content, so an insertion changes the chunks around it and no others. A chunk whose digest
occurred before, by doc_id, digest of the text and place, is a duplicate; a run of duplicate chunks of at
least `RUN` bytes is removed, shorter ones stay, since short phrases coincide by chance.

A chunk moves as its digest, its row and its number. The halves that stand at two places or more (of
different texts, or of one) find the few chunks that may occur again; only those get their place. The lists of
a text's chunks never move, but for the lengths of texts that have such chunks. Digests that more than one in
`HOT` of them share are fewer than `HOT`, and are joined by broadcast, the others by key, so that no task gets
all rows of a common digest.

Equal texts are one text with a count, of which the first document is kept as is and the others lose
everything, if the text has at least `least_copy` bytes (`RUN` unless given; 1: any that is not empty). Null texts are empty and keep what they have, null doc_ids come
last and are told apart by their texts' digests, like different texts of one doc_id; rows that repeat doc_id
and text are one document and get its result. A text of any length is cut and compared whole. Extra columns are ignored or
kept, no rows give no rows. Digests have 128 bits.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterscope.llm.shared import releases, steps, stored, unused

#: Bytes the hash depends on.
WINDOW = 16
#: Bytes of a chunk. `LEAST` may not be less than `WINDOW`.
LEAST = 16
MOST = 128
#: A chunk may end where this many highest bits of the hash are zero.
BITS = 4
#: Bytes of a run of duplicate chunks from which it is removed.
RUN = 128
#: Bound on the number of digests that are joined by broadcast.
HOT = 50_000

#: Numbers of which only the highest bits are random: shifted `WINDOW` times they are gone.
_GEAR = (np.random.default_rng(20_240_501).integers(0, 1 << WINDOW, 256, np.uint64) << np.uint64(32 - WINDOW)).astype(np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of the gears of the last 16, the j-th last shifted by j.
    Summed by doubling the stretch that is covered."""
    h, size = _GEAR[raw], 1
    while size < WINDOW:
        longer = h.copy()
        longer[size:] += h[:-size] << np.uint32(size)
        h, size = longer, 2 * size
    return h


def bounds(texts: list[bytes]) -> list[list[int]]:
    """Places where chunks end, for each text."""
    joined = b"".join(texts)
    ends = np.flatnonzero(gear(np.frombuffer(joined, np.uint8)) >> np.uint32(32 - BITS) == 0) + 1
    first = np.cumsum([0, *map(len, texts)])
    split = np.searchsorted(ends, first)
    out = []
    for k, t in enumerate(texts):
        mine = (ends[split[k] : split[k + 1]] - first[k]).tolist()
        n, at, found = len(t), 0, []
        while n - at > LEAST:
            # Within LEAST bytes of the text's start the hash still covers the text before; no chunk ends there.
            i = bisect_left(mine, at + LEAST)
            at = min(mine[i] if i < len(mine) else n, at + MOST, n)
            found.append(at)
        if at < n:
            if found:
                found[-1] = n
            else:
                found.append(n)
        out.append(found)
    return out


def _chunks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        texts = [t or b"" for t in batch.to_pylist()]
        sizes, lengths, digests = [], [], []
        for a, b in steps(texts):
            for t, found in zip(texts[a:b], bounds(texts[a:b]), strict=True):
                at = 0
                for end in found:
                    digests.append(xxhash.xxh3_128_digest(t[at:end]))
                    lengths.append(end - at)
                    at = end
                sizes.append(len(found))
        d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        at = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
        columns = (pa.array(lengths, pa.int32()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()))
        yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, c) for c in columns], names=["n", "d1", "d2"])


def runs(lengths: list[int], duplicate: list[int], least: int) -> list[tuple[int, int]]:
    """[start, end) of the runs of duplicate chunks (their numbers) that have enough bytes."""
    ends = np.cumsum([0, *lengths]).tolist()
    found: list[list[int]] = []
    for k in sorted(duplicate):
        if found and found[-1][1] == ends[k]:
            found[-1][1] = ends[k + 1]
        else:
            found.append([ends[k], ends[k + 1]])
    return [(a, b) for a, b in found if b - a >= least]


def _runs(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """struct(spans, repeated): runs of chunks that occurred before, and bytes in runs of chunks that occur
    elsewhere, before or after."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for lengths, shared in batches:
        found, repeated = [], []
        for x, y in zip(lengths.to_pylist(), shared.to_pylist(), strict=True):
            found.append([{"start": a, "end": b} for a, b in runs(x, [c["k"] for c in y if c["later"]], RUN)])
            repeated.append(sum(b - a for a, b in runs(x, [c["k"] for c in y], RUN)))
        yield pa.StructArray.from_arrays([pa.array(found, spans), pa.array(repeated, pa.int64())], names=["spans", "repeated"])


def _key(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


@releases
def duplicates(docs: DataFrame) -> DataFrame:
    """(t1, t2, first, several, spans, repeated) for texts of `docs` (doc_id, text as binary) that have
    something in common: the doc_id of the first document with the text, whether there are others, what
    that one loses, and how many of its bytes occur elsewhere."""
    found = F.arrow_udf(_chunks, "struct<n:array<int>,d1:array<long>,d2:array<long>>")
    rows = docs.select("doc_id", *_key(F.col("text")), found(F.col("text")).alias("chunks"))
    rows = stored(rows.select("doc_id", "t1", "t2", "chunks.*").withColumn("row", F.monotonically_increasing_id()), "chunks")
    none = F.col("doc_id").isNull().alias("none")
    copies = rows.groupBy("t1", "t2").agg(
        F.min(F.struct(none, "doc_id", "row")).alias("first"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        F.count("doc_id").alias("known"), F.count("*").alias("n"),
    )
    # More than one document: other doc_ids, or some and none; repeated rows of one doc_id are one.
    several = (F.col("low") < F.col("high")) | ((F.col("known") > 0) & (F.col("known") < F.col("n")))
    copies = stored(copies.where("n > 1").select("t1", "t2", "first", several.alias("several")), "copies")
    # Copies of a text have their chunks at the same places, so they need not be told apart here.
    text = F.xxhash64("t1", "t2").alias("text")
    at = rows.select(text, F.posexplode("d1").alias("k", "d1")).select("d1", F.xxhash64("text", "k").alias("at"))
    often = at.groupBy("d1").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low < high").select("d1")
    often = stored(often, "often")
    # The first row of each text stands for all.
    places = rows.select("row", none, "doc_id", "t1", "t2").join(copies, ["t1", "t2"], "left")
    places = stored(places.where("first is null or row = first.row").select("row", "none", "doc_id", "t1", "t2"), "places")
    each = rows.select("row", "d2", F.posexplode("d1").alias("k", "d1")).select("row", "k", "d1", F.get("d2", "k").alias("d2"))
    again = each.join(often.hint("merge"), "d1", "left_semi").join(places, "row")
    again = stored(again.select("row", "d1", "d2", F.struct("none", "doc_id", "t1", "t2", "k").alias("place")), "again")
    shared = again.groupBy("d1", "d2").agg(F.min("place").alias("one"), F.count("*").alias("n")).where("n > 1")
    shared = stored(shared, "shared")
    # The counts add up to the rows of `again` at most, so fewer than HOT digests have more than their share.
    fair = again.count() // HOT + 1
    hot, rest = shared.where(F.col("n") > fair).drop("n"), shared.where(F.col("n") <= fair).drop("n")
    found = again.join(F.broadcast(hot), ["d1", "d2"]).unionByName(again.join(rest.hint("merge"), ["d1", "d2"]))
    own = found.groupBy("row").agg(
        F.collect_list(F.struct(F.col("place.k").alias("k"), (F.col("place") > F.col("one")).alias("later"))).alias("shared")
    )
    spans = F.arrow_udf(_runs, "struct<spans:array<struct<start:int,end:int>>,repeated:long>")
    lost = rows.select("row", "t1", "t2", "doc_id", "n").join(own, "row").select("t1", "t2", "doc_id", spans(F.col("n"), F.col("shared")).alias("r"))
    lost = lost.select("t1", "t2", "doc_id", "r.*")
    fate = lost.where("repeated > 0").join(copies, ["t1", "t2"], "full").select(
        "t1", "t2", F.coalesce("first.doc_id", "doc_id").alias("first"), F.coalesce("several", F.lit(False)).alias("several"),
        "spans", F.coalesce("repeated", F.lit(0)).alias("repeated"),
    )
    return stored(fate.where("several or repeated > 0"), "fate")


def _spans_of(n: int, gone: bool | None, spans: list[dict] | None) -> list[tuple[int, int]]:
    if gone:
        return [(0, n)] if n else []
    return [(s["start"], s["end"]) for s in spans or ()]


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return b"".join([*kept, text[at:]])


def _report(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for text, gone, spans in batches:
        rows = []
        for t, g, s in zip(text.to_pylist(), gone.to_pylist(), spans.to_pylist(), strict=True):
            own = _spans_of(len(t), g, s)
            rows.append((len(t), sum(b - a for a, b in own), len(own), hashlib.sha256(_cut(t, own)).hexdigest()))
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.StructArray.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def _rest(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for text, gone, spans in batches:
        kept = [_cut(t, _spans_of(len(t), g, s)) for t, g, s in zip(text.to_pylist(), gone.to_pylist(), spans.to_pylist(), strict=True)]
        yield pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())


def _with_fate(docs: DataFrame, least_copy: int) -> tuple[DataFrame, str, list[Column]]:
    """`docs` with what their texts lose in a column, its name, and the arguments of what cuts them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    fate = duplicates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")))
    name = unused(docs, "chunk_fate")
    fate = fate.select(F.col("t1").alias(f"{name}1"), F.col("t2").alias(f"{name}2"), F.struct("first", "several", "spans", "repeated").alias(name))
    t1, t2 = _key(text)
    placed = docs.join(fate, (t1 == F.col(f"{name}1")) & (t2 == F.col(f"{name}2")), "left").drop(f"{name}1", f"{name}2")
    gone = F.col(f"{name}.several") & (F.length(text) >= least_copy) & ~F.col("doc_id").cast("long").eqNullSafe(F.col(f"{name}.first"))
    return placed, name, [text, gone, F.col(f"{name}.spans")]


def removals(docs: DataFrame, least_copy: int = RUN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, and n_repeated, the bytes that occur
    elsewhere, before or after: all of a text that another document has."""
    placed, name, arguments = _with_fate(docs.select("doc_id", "text"), least_copy)
    report = F.arrow_udf(_report, "struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string>")
    placed = placed.select(
        F.col("doc_id").cast("long").alias("doc_id"), report(*arguments).alias("r"), F.col(name).alias("fate")
    )
    whole = F.col("fate.several") & (F.col("r.n_bytes") >= least_copy)
    repeated = F.when(whole, F.col("r.n_bytes")).otherwise(F.coalesce("fate.repeated", F.lit(0)))
    return placed.select("doc_id", "r.*", repeated.cast("long").alias("n_repeated"))


def without_duplicates(docs: DataFrame, least_copy: int = RUN) -> DataFrame:
    """The rows with all their columns, duplicate runs cut out of `text`; null becomes empty."""
    placed, _, arguments = _with_fate(docs, least_copy)
    rest = F.arrow_udf(_rest, "string")(*arguments)
    return placed.withColumn("text", rest).select(*docs.columns)
