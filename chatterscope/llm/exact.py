"""Exact deduplication by Grace hashing.

Each task thins its rows with a table of its own to one head for each distinct text, so a text that a
third of all rows share leaves a task about once. The heads are partitioned by the first bits of a hash
of the text into buckets, which Spark spills to its shuffle files. A bucket whose bytes go beyond the
limit is partitioned again by more bits, level by level, until it fits or holds a single hash. Buckets
pass through an open-addressing table that compares complete contents and holds distinct ones only.

A null text counts as empty. The row with the largest doc_id stays; a null doc_id stays only where its
group has no other, and of rows that share doc_id and text one stays. Extra columns are ignored, no
rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterscope.llm.shared import stored, unused

#: Bytes of distinct text that a bucket's table may hold, unless they all have one hash.
BUCKET_BYTES = 8 << 20
#: Buckets that an oversized bucket is split into, as a power of two.
SPLIT_BITS = 4
#: Bytes of distinct text that a task's own table may hold; a full table is handed on and emptied.
TASK_BYTES = 32 << 20
_MASK = (1 << 64) - 1


class Table:
    """Open addressing with linear probing; contents are compared in full."""

    def __init__(self, slots: int = 64):
        self.slots: list[int] = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find(self, h: int, content: bytes) -> tuple[int, bool]:
        """The place of the content among the distinct ones, and whether it is new."""
        mask = len(self.slots) - 1
        at = (h ^ (h >> 32)) & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return k, False
            at = (at + 1) & mask
        k = self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return k, True

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for k, h in enumerate(self.hashes):
            at = (h ^ (h >> 32)) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def _thin(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """struct(row, head): a number of the row, and that of the first row with the same text which the
    task's table holds."""
    table, first = Table(), []
    row = TaskContext.get().partitionId() << 33
    for text, h in batches:
        rows, heads = [], []
        for content, key in zip(text.to_pylist(), h.to_pylist(), strict=True):
            if table.bytes > TASK_BYTES:
                table, first = Table(), []
            k, new = table.find(key & _MASK, content)
            if new:
                first.append(row)
            rows.append(row)
            heads.append(first[k])
            row += 1
        yield pa.StructArray.from_arrays([pa.array(rows, pa.int64()), pa.array(heads, pa.int64())], names=["row", "head"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first head of the same text, for each head. Rows come bucket by bucket."""
    table, first, bucket = Table(), [], None
    for batch in batches:
        found = []
        columns = [batch.column(c).to_pylist() for c in ("bits", "bucket", "h", "head", "text")]
        for bits, number, h, head, text in zip(*columns, strict=True):
            if (bits, number) != bucket:
                table, first, bucket = Table(), [], (bits, number)
            k, new = table.find(h & _MASK, text)
            if new:
                first.append(head)
            found.append(first[k])
        yield pa.RecordBatch.from_arrays([batch.column("head"), pa.array(found, pa.int64())], names=["head", "class"])


def _in_buckets(heads: DataFrame, bucket_bytes: int) -> DataFrame:
    """`heads` (h, n_bytes and more) with `bits` and `bucket`, the first bits of the hash."""
    total = heads.agg(F.sum("n_bytes")).first()[0] or 0
    start = max(1, math.ceil(math.log2(max(1.0, 2 * total / bucket_bytes))))
    bucket = F.expr("shiftrightunsigned(h, 64 - bits)")
    placed = heads.withColumn("bits", F.lit(start)).withColumn("bucket", bucket)
    while True:
        sizes = placed.groupBy("bits", "bucket").agg(
            F.sum("n_bytes").alias("size"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        over = stored(sizes.where((F.col("size") > bucket_bytes) & (F.col("low") != F.col("high"))).select("bits", "bucket"), "oversized")
        if over.isEmpty():
            return placed
        over = over.withColumn("more", F.lit(SPLIT_BITS))
        placed = (
            placed.join(over, ["bits", "bucket"], "left")
            .withColumn("bits", F.least(F.lit(64), F.col("bits") + F.coalesce("more", F.lit(0))))
            .withColumn("bucket", bucket)
            .drop("more")
        )


def _grouped(docs: DataFrame, bucket_bytes: int) -> tuple[DataFrame, DataFrame, str]:
    """`docs` stored with a column of row numbers and heads; what became of each head; that column's name."""
    name = unused(docs, "dedup")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    numbered = F.arrow_udf(_thin, "struct<row:long,head:long>")(text, F.xxhash64(text))
    rows = stored(docs.withColumn(name, numbered), "numbered")
    row, head = F.col(name)["row"], F.col(name)["head"]
    heads = rows.where(row == head).select(
        head.alias("head"), text.alias("text"), F.xxhash64(text).alias("h"), F.length(text).cast("long").alias("n_bytes")
    )
    buckets = _in_buckets(heads, bucket_bytes)
    classes = (
        buckets.select("bits", "bucket", "h", "head", "text")
        .repartition("bits", "bucket")
        .sortWithinPartitions("bits", "bucket")
        .mapInArrow(_compare, "head long, class long")
    )
    classes = stored(classes, "classes")
    of_head = rows.groupBy(head.alias("head")).agg(
        F.count("*").alias("n"), F.max(F.struct(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"))).alias("last")
    )
    of_class = classes.join(of_head, "head").groupBy("class").agg(
        F.sum("n").alias("group_size"), F.max("last").alias("keep")
    )
    fate = classes.join(of_class, "class").select("head", "group_size", "keep")
    return rows, fate, name


def deduplicate(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row with the id that stays for its text, the number of rows with that text, whether the
    row stays, and the text's digest."""
    rows, fate, name = _grouped(docs.select(F.col("doc_id").cast("long"), "text"), bucket_bytes)
    own = F.col(name)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = rows.select("doc_id", own["row"].alias("row"), own["head"].alias("head"), F.sha2(text, 256).alias("text_sha256"))
    return rows.join(fate, "head").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"
    )


def distinct(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows that stay, with all their columns."""
    rows, fate, name = _grouped(docs, bucket_bytes)
    kept = fate.select(F.col("keep.row").alias(f"{name}_kept")).distinct()
    return rows.join(kept, F.col(name)["row"] == F.col(f"{name}_kept"), "left_semi").drop(name)
