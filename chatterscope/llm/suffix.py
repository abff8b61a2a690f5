"""Repeated byte strings by distributed prefix doubling.

Every byte that some string of `threshold` bytes covers which also starts elsewhere is found exactly,
without sorting all positions.

1.  Each string of the threshold's length, a window, is owned by one position in it, its anchor: where
    the hash of the next 64 bytes is least, leftmost first. Equal windows have equal anchors at equal
    distances, and consecutive windows mostly share theirs, so about two positions in threshold - 64 are
    anchors (one in 130 was counted at 400).
2.  Anchors with unique next 64 bytes own unique windows and are dropped. Anchors whose windows span the
    same bytes are one class. A class of several anchors is repeated as a whole; one whose first 64
    bytes no other class shares is settled. Only the others, one for each class, go on.
3.  Prefix doubling: positions every 64 bytes to both sides of the anchor are ranked by the next 64
    bytes, then pairs of ranks at offsets of 1, 2, ... blocks are sorted and ranked anew, unique ones
    dropped, until the strings span the part that 64 neighbouring windows share, their core.
4.  A window around a core that is still not unique is ranked by the pair of its core's rank and the hash of
    what it has before and behind the core, fewer than threshold - (threshold - 63) // 64 * 64 + 1 bytes.
    Those of equal rank are repeated; the core's bytes are looked at by doubling alone.

Equal texts are one text with a count: of the threshold's length or more, it is repeated as a whole.
Hot classes, ranks and windows are counted with partial sums before they move, and joins that bring
counts back split skewed keys. Classes are told apart by 128 bits (those of the anchor's block and of the
spanned bytes), windows by the rank and 64 bits, ranks exactly.

Strings of two lengths cost little more than those of the shorter one: all that a longer string covers lies
within runs of the shorter, so only runs of the longer one's length and more are looked at again, as texts.

Null texts are empty; texts shorter than the threshold keep every byte, others of any length are looked at
whole. A null doc_id is a document like any other, repeated rows are documents with equal texts. Extra
columns are ignored or kept, no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterscope.llm import words
from chatterscope.llm.shared import release, releases, steps, stored, unused

#: Bytes of a repeated string, unless others are asked for; from `LEAST` on.
THRESHOLD = 400
#: Bytes that make a position's first rank, and the distance of ranked positions. A power of two.
BLOCK = 64
LEAST = 3 * BLOCK
#: Bytes of a repeated passage: fifty-one words of the documents at sf 0.1 have some 316, about 1 % of them fewer than this.
PASSAGE = 250
#: Window starts of a longer text that are looked at together.
SLICE = 1 << 22
#: Values (of some 20 bytes) of a measured table up to which a join broadcasts it; beyond, both sides are
#: shuffled.
BROADCAST_VALUES = 1_000_000

_RANDOM = np.random.default_rng(20_240_401)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RANDOM.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def block_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the BLOCK bytes from each position on, by doubling."""
    h, size = _BYTE[raw], 1
    while size < BLOCK:
        h = h[:-size] * _FACTORS[size.bit_length()] + h[size:]
        size *= 2
    return words.mix(h)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def anchors(texts: list[bytes], threshold: int = THRESHOLD) -> tuple[np.ndarray, ...]:
    """(text, anchor, first and last window start, hash of the anchor's block, hash of the bytes that its
    windows span) of every anchor; places count from the start of its text."""
    pieces = []  # of texts, so long that each window start of the text lies in one
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - threshold + 1, 0), SLICE):
            pieces.append((k, at, t[at : at + SLICE + threshold - 1]))
    out: list[tuple[np.ndarray, ...]] = []
    for first, last in steps([p[2] for p in pieces]):
        joined = b"".join(p[2] for p in pieces[first:last])
        ends = np.cumsum([len(p[2]) for p in pieces[first:last]])
        starts = np.concatenate([[0], ends[:-1]])
        h = block_hashes(np.frombuffer(joined, np.uint8))
        ordered = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
        at = (_least(ordered, threshold - BLOCK + 1) & ~_HIGH).astype(np.int64)
        inside = np.zeros(len(joined) + 1, np.int32)
        inside[starts] += 1
        inside[ends - threshold + 1] -= 1
        windows = np.flatnonzero(np.cumsum(inside)[: len(at)])
        new = (np.diff(windows, prepend=-2) != 1) | (np.diff(at[windows], prepend=-1) != 0)
        begins = np.flatnonzero(new)
        new_piece = np.searchsorted(windows, starts)  # pieces that touch have no gap between their windows
        begins = np.union1d(begins, new_piece)
        low = windows[begins]
        high = windows[np.append(begins[1:], len(windows)) - 1]
        owner = np.searchsorted(ends, low, "right")
        spanned = [xxhash.xxh3_64_intdigest(joined[a : b + threshold]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        shift = np.array([p[1] for p in pieces[first:last]])[owner] - starts[owner]
        text = np.array([p[0] for p in pieces[first:last]])[owner]
        c = np.array(spanned, np.uint64).view(np.int64)
        out.append((text, at[low] + shift, low + shift, high + shift, h[at[low]].view(np.int64), c))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(threshold: int):
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t or b"" for t in batch.to_pylist()]
            text, at, low, high, g, c = anchors(texts, threshold)
            offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            fields = pa.StructArray.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(g), pa.array(c)],
                names=["a", "lo", "hi", "g", "c"],
            )
            yield pa.ListArray.from_arrays(pa.array(offsets), fields)

    return find


def _regions(threshold: int):
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes that each wanted anchor's windows span."""
        for batch in batches:
            rows = [
                (w["g"], row, w["settled"], w["lo"], w["a"] - w["lo"], text[w["lo"] : w["hi"] + threshold])
                for text, row, wanted in zip(*(batch.column(c).to_pylist() for c in ("text", "row", "wanted")), strict=True)
                for w in wanted
            ]
            yield pa.RecordBatch.from_pylist([dict(zip(_REGION.names, r, strict=True)) for r in rows], schema=_REGION)

    return take


_REGION = pa.schema(
    [("g", pa.int64()), ("row", pa.int64()), ("settled", pa.bool_()), ("lo", pa.int32()), ("a", pa.int32()), ("region", pa.binary())]
)


def blocks_of(threshold: int) -> tuple[int, int]:
    """(ranked positions to either side of an anchor, blocks that BLOCK neighbouring windows share)."""
    return (threshold - BLOCK) // BLOCK, (threshold - BLOCK + 1) // BLOCK


def _bits(threshold: int) -> int:
    """Bits that hold the distance of a window's start from its anchor, or from its region's start."""
    return (threshold - BLOCK).bit_length()


def _windows(threshold: int):
    """(rank, rest, place) of the windows around live cores. rank: the core's, and the window's distance from
    its anchor, in one number. rest: hash of what lies before and behind the core. place: region and
    window start in one number, -1 for regions that are settled."""
    _, core = blocks_of(threshold)
    bits = _bits(threshold)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regions = batch.column("region").to_pylist()
            for first, last in steps(regions):
                begin = np.cumsum([0, *map(len, regions[first:last])])
                raw = np.frombuffer(b"".join(regions[first:last]), np.uint8)
                made = [[np.zeros(0, np.int64)] for _ in range(4)]
                columns = [batch.column(c).slice(first, last - first).to_pylist() for c in ("region", "region_id", "settled", "a", "cores")]
                for k, (region, number, settled, a, cores) in enumerate(zip(*columns, strict=True)):
                    count = len(region) - threshold + 1
                    for c in cores:
                        # The core begins u blocks before the anchor; the windows that start in the block before its second byte share it.
                        u = c["u"]
                        at = np.arange(max(a - BLOCK * (u + 1) + 1, 0), min(a - BLOCK * u + 1, count))
                        made[0].append(begin[k] + at)
                        made[1].append(a - BLOCK * u - at)
                        made[2].append((c["rank"] << bits) | (a - at))
                        made[3].append(np.full(len(at), -1) if settled else (number << bits) | at)
                start, before, ranks, places = (np.concatenate(x) for x in made)
                values, behind = _BYTE[raw], start + before + BLOCK * core
                rest = words.mix(words.ranges(values, start, start + before) * _FACTORS[34] + words.ranges(values, behind, start + threshold))
                yield pa.RecordBatch.from_arrays([pa.array(ranks), pa.array(rest.view(np.int64)), pa.array(places)], names=["rank", "rest", "place"])

    return rank


def _joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Spans [start, end), in any order and each in one number, as maximal runs."""
    for batch in batches:
        values, at = batch.values.to_numpy(), batch.offsets.to_numpy()
        starts, ends, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for first, last in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            spans = np.sort(values[first:last])
            start, reach = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
            new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
            starts.append(start[new])
            ends.append(reach[np.append(new[1:], len(spans)) - 1])
            sizes.append(len(new))
        runs = [pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, ends)]
        offsets = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
        yield pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(runs, names=["start", "end"]))


def _key(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _small(df: DataFrame, values: Column | None = None) -> DataFrame:
    """`df`, a stored table, marked for broadcast if it was counted and is small. values: how many a row
    holds, if not a few."""
    size = df.agg(F.sum(F.lit(1) if values is None else values)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_VALUES else df


def _reranked(state: DataFrame, step: int, n: int) -> DataFrame:
    """Positions ranked by the pair of ranks here and `step` positions on; unique ones get no rank.

    state: region_id, g, r (ranks by position, n of them); released, if it was stored. Strings are compared at equal
    places to equal anchors.
    """
    pair = F.transform(F.sequence(F.lit(0), F.lit(n - 1 - step)), lambda k: F.struct(F.get("r", k).alias("x"), F.get("r", k + step).alias("y")))
    pairs = state.select("region_id", "g", F.posexplode(pair).alias("t", "p")).select("region_id", "g", "t", "p.x", "p.y")
    pairs = pairs.where("x is not null and y is not null")
    ranks = pairs.groupBy("g", "t", "x", "y").agg(F.count("*").alias("n"), F.min("region_id").alias("rank"))
    back = pairs.join(ranks.where("n > 1").drop("n"), ["g", "t", "x", "y"])
    found = back.groupBy("region_id", "g").agg(F.map_from_entries(F.collect_list(F.struct("t", "rank"))).alias("m"))
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.try_element_at("m", k))
    ranked = stored(found.select("region_id", "g", places.alias("r")), "ranks")
    release(state)
    return ranked


def _cores(regions: DataFrame, threshold: int) -> DataFrame:
    """(region_id, cores): the cores that occur in several regions, by how many blocks before the anchor they
    begin (u), and their ranks."""
    reach, core = blocks_of(threshold)
    n = 2 * reach + 1
    at = lambda t: F.col("a") + (t - reach) * BLOCK
    inside = lambda t: (at(t) >= 0) & (at(t) + BLOCK <= F.length("region"))
    first = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda t: F.when(inside(t), F.xxhash64(F.substring("region", at(t) + 1, F.lit(BLOCK)))),
    )
    state = _reranked(regions.select("region_id", "g", first.alias("r")), 0, n)
    blocks = 1
    while blocks < core:
        step = min(blocks, core - blocks)
        state = _reranked(state, step, n)
        blocks += step
    live = state.select("region_id", F.posexplode("r").alias("t", "rank")).where(f"rank is not null and t <= {reach}")
    cores = live.groupBy("region_id").agg(F.collect_list(F.struct((F.lit(reach) - F.col("t")).alias("u"), "rank")).alias("cores"))
    cores = stored(cores, "cores")
    release(state)
    return cores


@releases
def repeated(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(t1, t2, whole, spans) of the texts of `docs` (doc_id, text as binary) that have repeated bytes:
    all of them, or those in the runs [start, end) of spans."""
    if threshold < LEAST:
        raise ValueError(f"a threshold of {threshold} bytes is below {LEAST}")
    keyed = docs.select("doc_id", "text", *_key(F.col("text")))
    found = F.arrow_udf(_anchors(threshold), "array<struct<a:int,lo:int,hi:int,g:long,c:long>>")
    rows = keyed.select("doc_id", "t1", "t2", F.length("text").alias("n_bytes"), found(F.col("text")).alias("anchors"))
    rows = stored(rows.where(f"n_bytes >= {threshold}").withColumn("row", F.monotonically_increasing_id()), "anchors")
    copies = rows.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("row").alias("one")).where("n > 1").drop("n")
    copies = stored(copies, "copies")
    # The first row of each text stands for all.
    one = rows.join(_small(copies), ["t1", "t2"], "left").where("one is null or row = one")
    one = one.withColumn("copied", F.col("one").isNotNull())
    places = one.select("row", "copied", F.explode("anchors").alias("x")).select("row", "copied", "x.*")
    classes = places.groupBy("g", "c").agg(
        ((F.count("*") > 1) | F.bool_or("copied")).alias("settled"), F.min(F.struct("row", "a", "lo", "hi")).alias("one")
    )
    classes = stored(classes.select("g", "c", "settled", "one.*"), "classes")
    contested = stored(classes.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "contested")
    regions = _wanted_regions(keyed, rows, classes.join(_small(contested), "g"), threshold)
    cores = _cores(regions, threshold)
    windows = regions.join(cores, "region_id").select("region_id", "settled", "a", "region", "cores")
    windows = windows.mapInArrow(_windows(threshold), "rank long, rest long, place long")
    # Each step's shuffle files go before the next one makes its own.
    twice = stored(windows.groupBy("rank", "rest").agg(F.count("*").alias("n")).where("n > 1").select("rank", "rest"), "twice")
    bits = _bits(threshold)
    hits = windows.where("place >= 0").join(twice, ["rank", "rest"]).select(
        F.shiftright("place", bits).alias("region_id"), F.col("place").bitwiseAND((1 << bits) - 1).cast("int").alias("at")
    )
    one_number = lambda start, end: (F.shiftleft(start.cast("long"), 32) + end).alias("span")
    start = F.col("lo") + F.col("at")
    by_window = hits.join(regions.select("region_id", "row", "lo"), "region_id").select("row", one_number(start, start + threshold))
    by_window = stored(by_window, "hits")
    for table in (regions, cores, twice):
        release(table)
    whole_class = stored(classes.where("settled").select("g", "c"), "settled")
    by_class = places.where("not copied").join(_small(whole_class), ["g", "c"]).select(
        "row", one_number(F.col("lo"), F.col("hi") + threshold)
    )
    spans = by_class.unionByName(by_window).groupBy("row").agg(F.collect_list("span").alias("spans"))
    runs = F.arrow_udf(_joined, "array<struct<start:int,end:int>>")
    in_part = spans.select("row", runs(F.col("spans")).alias("spans")).join(rows.select("row", "t1", "t2"), "row")
    in_part = in_part.select("t1", "t2", F.lit(False).alias("whole"), "spans")
    as_whole = copies.select("t1", "t2", F.lit(True).alias("whole"), F.lit(None).cast(in_part.schema["spans"].dataType).alias("spans"))
    return stored(in_part.unionByName(as_whole), "repeated")


def _wanted_regions(keyed: DataFrame, rows: DataFrame, wanted: DataFrame, threshold: int) -> DataFrame:
    """(region_id, row, settled, lo, a, g, region) for anchors `wanted`: the bytes their windows span."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("settled", "a", "lo", "hi", "g")).alias("wanted"))
    lists = stored(lists.join(rows.select("row", "doc_id", "t1", "t2"), "row"), "wanted")
    if lists.count() <= BROADCAST_VALUES:  # texts without a wanted anchor need not move
        keyed = keyed.join(F.broadcast(lists.select("t1", "t2")), ["t1", "t2"], "left_semi")
    lists = lists.withColumnsRenamed({"doc_id": "d", "t1": "u1", "t2": "u2"})
    same = (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")) & F.col("doc_id").eqNullSafe(F.col("d"))
    found = keyed.join(lists, same).select("text", "row", "wanted").mapInArrow(
        _regions(threshold), "g long, row long, settled boolean, lo int, a int, region binary"
    )
    # Rows that repeat doc_id and text bring a settled region twice, which does no harm.
    return stored(found.withColumn("region_id", F.monotonically_increasing_id()), "regions")


def gone(n: int, whole: bool | None, runs: list[dict] | None) -> list[tuple[int, int]]:
    """What goes of a text of n bytes."""
    return [(0, n)] if whole else [(r["start"], r["end"]) for r in runs or ()]


def cut_out(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in runs:
        kept.append(text[at:start])
        at = end
    return b"".join([*kept, text[at:]])


def _parts(threshold: int):
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of `threshold` bytes and more, each a text of its own."""
        for batch in batches:
            rows = [
                (t1, t2, start, text[start:end])
                for text, t1, t2, whole, runs in zip(*(batch.column(c).to_pylist() for c in ("text", "t1", "t2", "whole", "spans")), strict=True)
                for start, end in gone(len(text), whole, runs)
                if end - start >= threshold
            ]
            yield pa.RecordBatch.from_pylist([dict(zip(_PART.names, r, strict=True)) for r in rows], schema=_PART)

    return take


_PART = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int32()), ("text", pa.binary())])


@releases
def repeated_twice(docs: DataFrame, threshold: int, shorter: int) -> DataFrame:
    """As `repeated` of `threshold`, with spans even where all goes, and n_repeated: the bytes that strings of `shorter`
    bytes cover which also start elsewhere, null for all of them. Texts that only `shorter` finds have null spans.

    Wherever a longer string starts, the shorter ones in it are repeated, so that it lies within one of their runs: in
    the runs, taken as texts, it is repeated as in the whole texts, and nothing else is.
    """
    if shorter >= threshold:
        raise ValueError(f"{shorter} bytes are no shorter than {threshold}")
    runs = repeated(docs, shorter)
    keyed = docs.select("text", *_key(F.col("text")))
    parts = keyed.join(_small(runs, _values("spans")), ["t1", "t2"]).mapInArrow(_parts(threshold), "t1 long, t2 long, start int, text binary")
    parts = stored(parts.withColumn("doc_id", F.monotonically_increasing_id()), "parts")
    fate = repeated(parts, threshold).withColumnsRenamed({"t1": "p1", "t2": "p2"})
    p1, p2 = _key(F.col("text"))
    places = parts.select("t1", "t2", "start", (F.col("start") + F.length("text")).alias("end"), p1.alias("p1"), p2.alias("p2"))
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), (F.col("end") - F.col("start")).alias("end")))
    found = places.join(_small(fate, _values("spans")), ["p1", "p2"])
    found = found.select("t1", "t2", "start", F.explode(F.when(F.col("whole"), all_of_it).otherwise(F.col("spans"))).alias("s"))
    # Copies of a text bring the same spans; those of a text's parts do not touch.
    span = F.struct((F.col("start") + F.col("s.start")).alias("start"), (F.col("start") + F.col("s.end")).alias("end"))
    spans = found.groupBy("t1", "t2").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    short = runs.select("t1", "t2", F.when(~F.col("whole"), covered).alias("n_repeated"))
    return stored(short.join(spans, ["t1", "t2"], "left").select("t1", "t2", F.lit(False).alias("whole"), "spans", "n_repeated"), "repeated")


def _values(spans: str) -> Column:
    return F.lit(1) + F.coalesce(F.size(F.col(spans)), F.lit(0))


def _with_fate(docs: DataFrame, text: Column, threshold: int, shorter: int | None = None) -> tuple[DataFrame, str]:
    """`docs` with a column (whole, spans) and its name; with n_repeated in it, if strings of `shorter` are looked for too."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    name = unused(docs, "repeated")
    found = repeated(plain, threshold) if shorter is None else repeated_twice(plain, threshold, shorter)
    fate = found.select(F.col("t1").alias(f"{name}1"), F.col("t2").alias(f"{name}2"), F.struct(*found.columns[2:]).alias(name))
    t1, t2 = _key(text)
    return docs.join(_small(fate, _values(f"{name}.spans")), (t1 == F.col(f"{name}1")) & (t2 == F.col(f"{name}2")), "left").drop(f"{name}1", f"{name}2"), name


def _binary() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")


def _report(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for text, whole, spans in batches:
        rows = []
        for t, w, s in zip(text.to_pylist(), whole.to_pylist(), spans.to_pylist(), strict=True):
            runs = gone(len(t), w, s)
            rows.append((len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(cut_out(t, runs)).hexdigest()))
        n, gone_, spans_, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(gone_, pa.int64()), pa.array(spans_, pa.int64()), pa.array(digest, pa.string())],
            names=["n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _rest(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for text, whole, spans in batches:
        kept = [cut_out(t, gone(len(t), w, s)) for t, w, s in zip(text.to_pylist(), whole.to_pylist(), spans.to_pylist(), strict=True)]
        yield pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())


def removals(docs: DataFrame, threshold: int = THRESHOLD, shorter: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row. With `shorter`, from LEAST to below the
    threshold, also n_repeated: how many bytes strings of that length cover which also start elsewhere. They stay."""
    placed, name = _with_fate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _binary(), threshold, shorter)
    report = F.arrow_udf(_report, "struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string>")
    made = [report(_binary(), F.col(f"{name}.whole"), F.col(f"{name}.spans")).alias("r")]
    if shorter is not None:
        made.append(F.when(F.col(name).isNull(), 0).otherwise(F.coalesce(f"{name}.n_repeated", F.length(_binary()))).cast("long").alias("n_repeated"))
    return placed.select("doc_id", *made).select("doc_id", "r.*", *(["n_repeated"] if shorter is not None else []))


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows with all their columns, repeated bytes cut out of `text` (and what is left of a cut
    character), and `n_chars`, if there, counted anew. A row without repeats stays as it is."""
    placed, name = _with_fate(docs, _binary(), threshold)
    rest = F.arrow_udf(_rest, "string")(_binary(), F.col(f"{name}.whole"), F.col(f"{name}.spans"))
    cut, new = F.col(name).isNotNull(), f"{name}_text"
    placed = placed.withColumn(new, rest)
    made = {"text": F.when(cut, F.col(new)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(cut, F.length(new).cast("long")).otherwise(F.col("n_chars"))
    return placed.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])
