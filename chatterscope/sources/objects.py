"""Landed JSON objects in any layout, cut into their top-level entries by many tasks.

Every record of an object is an object itself, so each ends with a closing brace. Text is read up to one
closing brace after the other (a *piece*), which Spark can begin anywhere in a file. Whether such a brace ends
a record depends on all that stands before it: on being inside a string, and on the depth. Both are summed up:

1. Each piece counts its quotes and its braces and brackets, as if it began outside a string and as if inside.
   No escape reaches over its end, as what would be escaped is the brace that ended the piece before.
2. Each block of a file is one row of those sums, for both ways it may begin. A window over the blocks of a
   file gives each its true beginning.
3. Pieces are joined up to each brace that ends a record. What crosses the ends of blocks is put together by
   file and block; only that is shuffled.

Blocks may be much smaller than what a task should read: a task takes so many of them, one after the other, that
their bytes come to `TASK_BYTES`.

The text is read three times and its pieces pass through Arrow: the harvest's indented layout is cheaper.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatterscope.operators.joins import BROADCAST_ROW_LIMIT, BROADCAST_SHARE, executor_bytes

_END = "}"
#: What would be put together from more bytes is no record; it comes back in parts, as unreadable.
LONGEST = 256 << 20
#: Bytes of blocks that a task reads, if there are more tasks than cores.
TASK_BYTES = 32 << 20
#: Bytes of a row of the table of blocks, besides the name of its file.
_BLOCK_ROW = 64
_NUMBERS = ["quotes", "from_outside", "from_inside"]
_BLOCK = "file string, start long, quotes long, outside long, inside long, least_outside long, least_inside long, bytes long, size long"
_STRETCH = "file string, start long, row long, opened long, whole boolean, value binary"


def _pieces(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """`file, start, row, size, value`, and what each piece counts."""
    text = spark.read.option("lineSep", _END).text(list(paths))
    start = F.coalesce(F.col("_metadata.file_block_start"), F.lit(0))
    placed = text.select(
        F.col("_metadata.file_path").alias("file"), start.alias("start"), F.monotonically_increasing_id().alias("row"),
        F.col("_metadata.file_size").alias("size"), "value",
        F.regexp_replace("value", r"\\(?s:.)", "").alias("_plain"),
    )
    quotes = F.length("_plain") - F.length(F.replace("_plain", F.lit('"')))
    string = r'"[^"]*("|\z)'
    outside = F.regexp_replace("_plain", string, "")
    inside = F.regexp_replace(F.regexp_replace("_plain", r'\A[^"]*("|\z)', ""), string, "")
    # The brace that ended the piece counts where it is outside a string.
    ends = lambda odd: F.when(quotes % 2 == odd, 1).otherwise(0)
    return placed.select(
        "file", "start", "row", "size", "value", quotes.cast("long").alias("quotes"),
        (_deeper(outside) - ends(0)).cast("long").alias("from_outside"),
        (_deeper(inside) - ends(1)).cast("long").alias("from_inside"),
    )


def _deeper(text: Column) -> Column:
    """Opened braces and brackets less closed ones."""
    marks = lambda drop: F.length(F.translate(text, drop, ""))
    return marks("}]") - marks("{[")


def _runs(frame: pd.DataFrame) -> Iterator[tuple[tuple[str, int], slice]]:
    """The stretches of rows of one file and block."""
    files, starts = frame["file"].to_numpy(), frame["start"].to_numpy()
    cuts = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(frame)]):
        if b > a:
            yield (files[a], int(starts[a])), slice(a, b)


def _walk(frame: pd.DataFrame, rows: slice, quoted: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Quotes so far and depth after each piece, from a beginning in a string (odd) or outside."""
    quotes, outside, inside = (frame[c].to_numpy()[rows] for c in _NUMBERS)
    after = quoted + np.cumsum(quotes)
    return after, depth + np.cumsum(np.where((after - quotes) % 2 == 1, inside, outside))


def _summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a block: quotes, change of depth, and the least depth at a brace outside strings, relative to
    the beginning, for both beginnings. A block's pieces come in order, from one task."""
    high = 1 << 60

    def row(at: tuple[str, int], sums: list) -> pd.DataFrame:
        return pd.DataFrame([[*at, *sums]], columns=[c.split()[0] for c in _BLOCK.split(", ")])

    at, sums = None, []
    for frame in frames:
        for key, rows in _runs(frame):
            if key != at:
                if at:
                    yield row(at, sums)
                at, sums = key, [0, 0, 0, high, high, 0, int(frame["size"].iloc[rows.start])]
            quotes = sums[0]
            for way in (0, 1):
                after, depth = _walk(frame, rows, quotes + way, sums[1 + way])
                sums[1 + way] = int(depth[-1])
                sums[3 + way] = min(sums[3 + way], int(np.where(after % 2 == 0, depth, high).min()))
            sums[0] = quotes + int(frame["quotes"].to_numpy()[rows].sum())
            sums[5] += int(frame["bytes"].to_numpy()[rows].sum())
    if at:
        yield row(at, sums)


def _blocks(pieces: DataFrame) -> DataFrame:
    """How each block begins (`quoted`, `depth`), the block where what it begins with was opened (`opened`, -1:
    with the file), and whether what it begins and ends with is too long (`lost_head`, `lost_tail`) or lacks
    its last brace (`unclosed`)."""
    sized = pieces.select("file", "start", "size", *_NUMBERS, (F.octet_length("value") + 1).cast("long").alias("bytes"))
    blocks = sized.mapInPandas(_summed, _BLOCK)
    file = Window.partitionBy("file")
    order = file.orderBy("start")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    quoted = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    blocks = blocks.withColumn("quoted", quoted)
    way = lambda name: F.when(F.col("quoted") == 1, F.col(f"{name}inside")).otherwise(F.col(f"{name}outside"))
    blocks = blocks.withColumns({"_change": way(""), "_least": way("least_")})
    blocks = blocks.withColumn("depth", F.coalesce(F.sum("_change").over(before), F.lit(0)))
    cut = F.when(F.col("depth") + F.col("_least") <= 1, F.col("start"))
    blocks = blocks.withColumn("_cut", cut)
    following = F.coalesce(F.first("_cut", ignorenulls=True).over(after), F.max("start").over(file))
    opened = F.coalesce(F.last("_cut", ignorenulls=True).over(before), F.lit(-1))
    # Each piece was counted with a brace. The reader leaves out a byte order mark, of three bytes.
    spare = F.sum("bytes").over(file) - F.col("size")
    return blocks.select(
        "file", "start", "quoted", "depth", opened.alias("opened"),
        (F.coalesce("_cut", following) - F.greatest(opened, F.lit(0)) > LONGEST).alias("lost_head"),
        (following - F.col("start") > LONGEST).alias("lost_tail"),
        (spare.isin(1, -2) & (F.col("start") == F.max("start").over(file))).alias("unclosed"),
    )


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches of a block, each up to a brace that ends a record, without that brace. `opened` names the
    block where a stretch began that this one belongs to, or is null for what stands on its own."""
    names = [c.split()[0] for c in _STRETCH.split(", ")]
    end = _END.encode()

    class Block:
        def __init__(self, key, first):
            self.key, self.first = key, first
            self.quoted, self.depth = int(first.quoted), int(first.depth)
            self.held: list[bytes] = []  # pieces since the last end of a record
            self.row = 0  # place of the first of them
            self.ready = None  # the last stretch, held back: its brace may be missing
            self.cuts = 0

        def stretch(self, head: bool, closed: bool) -> list:
            """What is held, as a row."""
            opened = self.first.opened if head else self.key[1]
            lost = self.first.lost_head if head else self.first.lost_tail
            alone = closed and (not head or self.key[1] == 0)
            joined = not lost and not alone
            return [*self.key, self.row, int(opened) if joined else None, closed and not lost, end.join(self.held)]

        def take(self, frame, rows):
            after, depth = _walk(frame, rows, self.quoted, self.depth)
            self.quoted, self.depth = int(after[-1]) % 2, int(depth[-1])
            values, places = frame["value"].to_numpy()[rows], frame["row"].to_numpy()[rows]
            begin = 0
            for last in np.flatnonzero((after % 2 == 0) & (depth <= 1)):
                self.hold(values[begin : last + 1], places[begin])
                if self.ready:
                    yield self.ready
                self.ready = self.stretch(head=not self.cuts, closed=True)
                self.cuts, self.held, begin = self.cuts + 1, [], last + 1
            if begin < len(values):
                self.hold(values[begin:], places[begin])

        def hold(self, values, place):
            if not self.held:
                self.row = int(place)
            self.held.extend(values)

        def rest(self):
            if self.ready:
                if self.first.unclosed and not self.held:
                    self.ready[4] = False
                yield self.ready
            if self.held:
                yield self.stretch(head=not self.cuts, closed=False)

    def table(rows):
        frame = pd.DataFrame(rows, columns=names)
        return frame.assign(opened=frame["opened"].astype("Int64"))

    block = None
    for frame in frames:
        made = []
        for key, rows in _runs(frame):
            if block is None or key != block.key:
                if block:
                    made.extend(block.rest())
                block = Block(key, frame.iloc[rows.start])
            made.extend(block.take(frame, rows))
        if made:
            yield table(made)
    if block:
        made = list(block.rest())
        if made:
            yield table(made)


def _planned(spark: SparkSession, paths: Sequence[str]) -> tuple[bool, int]:
    """Whether the table of blocks may be broadcast, and how many tasks are to read the blocks: by the lengths
    of the files, whose content is not read."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length")
    n, length, name = files.agg(F.count("*"), F.sum("length"), F.max(F.length("path"))).first()
    biggest = spark.sql("set spark.sql.files.maxPartitionBytes").first()["value"].lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    bytes_ = int(biggest[:-1]) * unit[biggest[-1]] if biggest[-1] in unit else int(biggest)
    blocks = n + (length or 0) // bytes_ + spark.sparkContext.defaultParallelism
    size = blocks * ((name or 0) + _BLOCK_ROW)
    few = blocks <= BROADCAST_ROW_LIMIT and size <= executor_bytes(spark) * BROADCAST_SHARE
    return few, max(spark.sparkContext.defaultParallelism, math.ceil((length or 0) / TASK_BYTES))


def stretches(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """`(value, file, place, whole)` for `landing.entries`: the entries of JSON objects, each without its last
    brace. What does not end with the brace of a record is not `whole`."""
    few, tasks = _planned(spark, paths)
    # Without a shuffle: blocks that one task takes follow each other whole.
    pieces = _pieces(spark, paths).coalesce(tasks)
    blocks = _blocks(pieces)
    if few:
        begun = pieces.join(F.broadcast(blocks), ["file", "start"])
    else:
        begun = pieces.join(blocks, ["file", "start"]).sortWithinPartitions("file", "start", "row")
    begun = begun.withColumn("value", F.col("value").cast("binary")).drop("size")
    cut = begun.mapInPandas(_cut, _STRETCH).withColumn("value", F.col("value").cast("string"))
    place = lambda at: F.struct("file", at["start"].alias("start"), at["row"].alias("row")).alias("place")
    inner = cut.where("opened is null").select("value", "file", place(F.struct("start", "row")), "whole")
    # At most two for each block, and for a record no more than `LONGEST` bytes and a block at both ends.
    parts = F.array_sort(F.collect_list(F.struct("start", "row", "value", "whole")))
    crossing = cut.where("opened is not null").groupBy("file", "opened").agg(parts.alias("parts"))
    crossing = crossing.select(
        F.array_join(F.transform("parts", lambda p: p["value"]), _END).alias("value"), "file",
        place(F.get("parts", F.lit(0))), F.element_at("parts", -1)["whole"].alias("whole"),
    )
    return inner.unionByName(crossing)
