"""Line deduplication by a sharded minimal perfect hash.

A line's key is the line without ASCII white space at its ends, in ASCII lower case; 96 bits name a key.

1.  Each document's lines are hashed once. Documents are dealt to blocks, and a block lists its distinct
    keys, sorted, with the number of its documents that have each. Spark sums these over blocks.
2.  The keys are cut by ranges of their first 64 bits into shards of about `SHARD` keys. A task turns a
    shard into arrays: a minimal perfect hash (levels of bits; a key's bit is set where no other key of
    its level falls, the others go on to the next level; a key's number is the number of set bits before
    its own) and, by that number, a fingerprint of 32 bits and the number of documents.
3.  Documents probe the arrays: each block's keys, already sorted, are cut into one packet for each shard,
    a shard's packets stream past its arrays, and each packet's answer is a bit for each key. Lines are
    not joined, and no task holds more than one shard and one packet.
4.  A block's answers tell its documents which of their lines go. Those numbers meet the texts by doc_id
    and digest.

A line that is in many documents is one key of a block, so no packet or shard grows with it. A document
counts once for a key, whatever number of its lines have it. Null and empty texts are one empty line, empty
keys (fewer than `LEAST_CHARS` code points) never go, texts of any length are handled whole. Null doc_ids and
repeated rows are documents like any other and count each time. Extra columns are ignored or kept, no rows
give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterscope.llm.shared import releases, stored, unused
from chatterscope.llm.words import mix

#: Documents that must have a key, and its code points, for its lines to go.
LEAST_DOCS = 10
LEAST_CHARS = 1
#: Keys of a shard, about: some 200 KB of arrays.
SHARD = 1 << 15
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 23
#: Bits of a level for each key that is left.
ROOM = 2.0
_ENDS = b" \t\n\v\f\r"

#: A key: its first 64 bits, which order keys and choose the shard, and 32 more, the fingerprint.
KEY = np.dtype([("h", "<u8"), ("f", "<u4")])


def key_of(line: bytes) -> bytes:
    return line.strip(_ENDS).lower()


def keys_of(text: bytes, least_chars: int) -> list[int]:
    """96 bits of each line's key, -1 for keys of too few code points."""
    found = []
    for line in text.split(b"\n"):
        key = key_of(line)
        # Code points are never more than bytes.
        long_ = len(key) >= least_chars and (least_chars <= 1 or len(key.decode("utf-8", "replace")) >= least_chars)
        found.append(xxhash.xxh3_128_intdigest(key) >> 32 if long_ else -1)
    return found


def packed(keys: list[int]) -> np.ndarray:
    """Keys as an array; keys[...]["h"] are the highest 64 of 96 bits."""
    raw = np.frombuffer(b"".join([k.to_bytes(12, "little") for k in keys]), np.dtype([("f", "<u4"), ("h", "<u8")]))
    out = np.empty(len(keys), KEY)
    out["h"], out["f"] = raw["h"], raw["f"]
    return out


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place below `size` for each key, others on each level."""
    seed = np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    h = mix((keys["h"] + seed) ^ (keys["f"].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
    return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class Perfect:
    """A minimal perfect hash of keys: numbers from 0 to n - 1 for the n keys it was built of."""

    def __init__(self, bits: bytes, levels: list[int]):
        """bits: those of all levels, one after the other; levels: how many each has."""
        self.bits, self.levels = np.frombuffer(bits, np.uint8), levels
        ones = np.bitwise_count(self.bits)
        self.before = np.cumsum(ones, dtype=np.int64) - ones

    @classmethod
    def of(cls, keys: np.ndarray) -> Perfect:
        parts, levels = [], []
        while len(keys):
            size = max(64, -(-int(len(keys) * ROOM) // 8) * 8)
            at = _places(keys, len(levels), size)
            count = np.bincount(at, minlength=size)
            parts.append(np.packbits(count == 1, bitorder="little").tobytes())
            levels.append(size)
            keys = keys[count[at] > 1]
        return cls(b"".join(parts), levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of others, any number or -1."""
        out, left, first = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.levels):
            at = first + _places(keys[left], level, size)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            held = self.bits[byte]
            hit = (held >> bit) & 1 == 1
            below = held[hit] & ((np.uint8(1) << bit[hit]) - np.uint8(1))
            out[left[hit]] = self.before[byte[hit]] + np.bitwise_count(below)
            left, first = left[~hit], first + size
        return out


class Shard:
    """The arrays of a shard."""

    def __init__(self, bits: bytes, levels: list[int], fingerprints: bytes, counts: bytes, width: int):
        self.perfect = Perfect(bits, levels)
        self.fingerprints, self.counts = np.frombuffer(fingerprints, "<u4"), np.frombuffer(counts, f"<u{width}")

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """In how many documents each key is; 0 for keys that the shard does not hold."""
        at = self.perfect.numbers(keys)
        out = np.zeros(len(keys), np.int64)
        known = np.flatnonzero(at >= 0)
        known = known[self.fingerprints[at[known]] == keys["f"][known]]
        out[known] = self.counts[at[known]]
        return out


_HASHED = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("lines", pa.binary()), ("n_keys", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())]
)


def hashed(docs: DataFrame, least_chars: int) -> DataFrame:
    """A row for each document of `docs` (doc_id, text as binary): its block, the digest of its text, and its
    lines as numbers of the block's keys plus one, 0 for those without key. The first row of a block holds
    the block's sorted keys and their numbers of documents. To be stored."""

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy() + 16
            owner = (np.cumsum(sizes) - sizes) // BLOCK_BYTES
            first = np.flatnonzero(np.diff(owner, prepend=-1)).tolist()
            for x, y in zip(first, [*first[1:], len(sizes)], strict=True):
                part = batch.slice(x, y - x)
                found = [keys_of(t, least_chars) for t in part.column("text").to_pylist()]
                keys = sorted({k for f in found for k in f if k >= 0})
                number = {-1: 0} | {k: i for i, k in enumerate(keys, 1)}
                docs_of = np.zeros(len(keys) + 1, np.int64)
                lines = []
                for f in found:
                    own = np.array([number[k] for k in f], "<u4")
                    docs_of[np.unique(own)] += 1
                    lines.append(own.tobytes())
                block, n = (TaskContext.get().partitionId() << 33) | made, y - x
                made += 1
                alone = lambda v: [v, *[None] * (n - 1)]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, block)), *(part.column(c) for c in ("doc_id", "t1", "t2")), pa.array(lines, pa.binary()), pa.array(np.full(n, len(keys))),
                        pa.array(alone(packed(keys).tobytes()), pa.binary()), pa.array(alone(docs_of[1:].astype("<u4").tobytes()), pa.binary()),
                    ],
                    schema=_HASHED,
                )

    t1, t2 = _digest(F.col("text"))
    read = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), "text")
    return read.mapInArrow(hash_, "block long, doc_id long, t1 long, t2 long, lines binary, n_keys long, keys binary, docs binary")


def _digest(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of blocks, a row each."""
    for batch in batches:
        for raw, docs in zip(batch.column("keys").to_pylist(), batch.column("docs").to_pylist(), strict=True):
            keys = np.frombuffer(raw, KEY)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys["h"].view(np.int64)), pa.array(keys["f"].view(np.int32)), pa.array(np.frombuffer(docs, "<u4").astype(np.int64))], names=["h", "f", "n"]
            )


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of equal length; keys that are sorted have sorted shards."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


_SHARD = "shard long, size long, bits binary, levels array<long>, fingerprints binary, counts binary, width int"


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards out of rows in the order of shards."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    open_ = -1

    def made() -> pa.RecordBatch:
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        perfect = Perfect.of(keys)
        at = perfect.numbers(keys)
        width = next(w for w in (1, 2, 4, 8) if int(n.max()) < 1 << 8 * w)
        fingerprints, counts = np.empty(len(keys), "<u4"), np.empty(len(keys), f"<u{width}")
        fingerprints[at], counts[at] = keys["f"], n
        row = {"shard": open_, "size": len(keys), "bits": perfect.bits.tobytes(), "levels": perfect.levels, "fingerprints": fingerprints.tobytes(), "counts": counts.tobytes(), "width": width}
        types = [("shard", pa.int64()), ("size", pa.int64()), ("bits", pa.binary()), ("levels", pa.list_(pa.int64())), ("fingerprints", pa.binary()), ("counts", pa.binary()), ("width", pa.int32())]
        return pa.RecordBatch.from_pylist([row], schema=pa.schema(types))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.empty(batch.num_rows, KEY)
        keys["h"] = batch.column("h").to_numpy().view(np.uint64)
        keys["f"] = batch.column("f").to_numpy().view(np.uint32)
        n, shard = batch.column("n").to_numpy(), batch.column("shard").to_numpy()
        first = np.flatnonzero(np.diff(shard, prepend=-1))
        for x, y in zip(first.tolist(), [*first[1:].tolist(), len(shard)], strict=True):
            if shard[x] != open_ and held:
                yield made()
                held = []
            open_ = int(shard[x])
            held.append((keys[x:y], n[x:y]))
    if held:
        yield made()


def index(rows: DataFrame) -> tuple[DataFrame, int]:
    """(the shards of all keys of `rows`, as `hashed` gives them, stored; their number)."""
    listed = rows.where("keys is not null").select("keys", "docs").mapInArrow(_listed, "h long, f int, n long")
    counts = stored(listed.groupBy("h", "f").agg(F.sum("n").alias("n")), "keys")
    shards = -(-counts.count() // SHARD) or 1
    # The range of the highest 32 bits of h, as in shard_of.
    shard = F.shiftright(F.shiftrightunsigned("h", 32) * F.lit(shards), 32).alias("shard")
    placed = counts.select(shard, "h", "f", "n").repartition("shard").sortWithinPartitions("shard")
    return stored(placed.mapInArrow(_built, _SHARD), "shards"), shards


def _packets(shards: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's keys, cut by shards."""
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                keys = np.frombuffer(raw, KEY)
                bounds = np.searchsorted(shard_of(keys["h"], shards), np.arange(shards + 1))
                held = np.flatnonzero(np.diff(bounds)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held, pa.int64()), pa.array([block] * len(held), pa.int64()), pa.array(bounds[held], pa.int64()), pa.array([keys[bounds[s] : bounds[s + 1]].tobytes() for s in held], pa.binary())],
                    names=["shard", "block", "at", "keys"],
                )

    return cut


def _probed(least_docs: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of shards, each shard's arrays before its packets."""
        own, open_ = None, None
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("shard", "block", "at", "keys")}
                if row["keys"] is None:
                    arrays = {c: batch.column(c)[r].as_py() for c in ("bits", "levels", "fingerprints", "counts", "width")}
                    own, open_ = Shard(**arrays), row["shard"]
                    continue
                if open_ != row["shard"]:
                    raise ValueError(f"no arrays for shard {row['shard']}")
                often = own.probe(np.frombuffer(row["keys"], KEY)) >= least_docs
                if often.any():
                    out.append((row["block"], row["at"], np.packbits(often, bitorder="little").tobytes()))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["block", "at", "often"])

    return probe


def probed(rows: DataFrame, arrays: DataFrame, shards: int, least_docs: int) -> DataFrame:
    """(block, at, often): which of a block's keys, from number `at` on, are in `least_docs` documents."""
    packets = rows.where("keys is not null").select("block", "keys").mapInArrow(_packets(shards), "shard long, block long, at long, keys binary")
    both = arrays.drop("size").unionByName(packets, allowMissingColumns=True)
    both = both.repartition("shard").sortWithinPartitions("shard", F.col("keys").isNotNull())
    return both.mapInArrow(_probed(least_docs), "block long, at long, often binary")


def _fates(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The lines that a block's documents lose, a bit each, for documents that lose some."""
    out = []
    if docs.num_rows and answers.num_rows:
        often = np.zeros(docs.column("n_keys")[0].as_py() + 8, bool)  # whole bytes may reach over the end
        for at, raw in zip(answers.column("at").to_pylist(), answers.column("often").to_pylist(), strict=True):
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").astype(bool)
            # Keys have numbers from 1 on; what lies behind a packet's last key is zero.
            often[at + 1 : at + 1 + len(bits)] |= bits[: len(often) - at - 1]
        for doc_id, t1, t2, raw in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "t1", "t2", "lines")), strict=True):
            gone = often[np.frombuffer(raw, "<u4")]
            if gone.any():
                out.append((doc_id, t1, t2, np.packbits(gone, bitorder="little").tobytes()))
    columns = zip(*out, strict=True) if out else ((), (), (), ())
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["d", "u1", "u2", "gone"])


@releases
def fates(docs: DataFrame, least_docs: int, least_chars: int) -> DataFrame:
    """(d, u1, u2, gone) of `docs` (doc_id, text as binary) that lose lines: doc_id, digest of the text, a bit
    for each line. Documents with one doc_id and text have the same lines, and one row here."""
    rows = stored(hashed(docs, least_chars), "lines")
    arrays, shards = index(rows)
    answers = probed(rows, arrays, shards, least_docs)
    own = rows.select("block", "doc_id", "t1", "t2", "n_keys", "lines")
    found = own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_fates, "d long, u1 long, u2 long, gone binary")
    return stored(found.dropDuplicates(["d", "u1", "u2"]), "fates")


def kept_lines(text: bytes, gone: bytes | None) -> tuple[int, list[bytes]]:
    """(number of lines, those that stay)."""
    lines = text.split(b"\n")
    if not gone:
        return len(lines), lines
    bits = np.unpackbits(np.frombuffer(gone, np.uint8), count=len(lines), bitorder="little").tolist()
    return len(lines), [line for line, g in zip(lines, bits, strict=True) if not g]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")


def _placed(docs: DataFrame, least_docs: int, least_chars: int) -> tuple[DataFrame, str]:
    """`docs` with a column of bits of lines that go, and its name."""
    doc_id = F.col("doc_id").cast("long")
    found = fates(docs.select(doc_id.alias("doc_id"), _text().alias("text")), least_docs, least_chars)
    name = unused(docs, "gone")
    own = {c: f"{name}_{c}" for c in ("d", "u1", "u2")}
    t1, t2 = _digest(_text())
    here = {"d": doc_id, "u1": t1, "u2": t2}
    found = found.withColumnsRenamed(own | {"gone": name})
    same = [here[c].eqNullSafe(F.col(own[c])) for c in own]
    return docs.join(found, same[0] & same[1] & same[2], "left").drop(*own.values()), name


def _report(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for text, gone in batches:
        n, dropped, digest = [], [], []
        for t, g in zip(text.to_pylist(), gone.to_pylist(), strict=True):
            lines, kept = kept_lines(t, g)
            n.append(lines)
            dropped.append(lines - len(kept))
            digest.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
        yield pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digest, pa.string())], names=["n_lines", "n_dropped", "kept_sha256"]
        )


def _rest(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for text, gone in batches:
        yield pa.array([b"\n".join(kept_lines(t, g)[1]).decode() for t, g in zip(text.to_pylist(), gone.to_pylist(), strict=True)], pa.string())


def removals(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row."""
    placed, name = _placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least_docs, least_chars)
    report = F.arrow_udf(_report, "struct<n_lines:long,n_dropped:long,kept_sha256:string>")
    return placed.select("doc_id", report(_text(), F.col(name)).alias("r")).select("doc_id", "r.*")


def without_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The rows with all their columns, frequent lines cut out of `text`, and `n_chars`, if there, counted
    anew. A row without such lines stays as it is."""
    placed, name = _placed(docs, least_docs, least_chars)
    cut, new = F.col(name).isNotNull(), f"{name}_text"
    placed = placed.withColumn(new, F.arrow_udf(_rest, "string")(_text(), F.col(name)))
    made = {"text": F.when(cut, F.col(new)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(cut, F.length(new).cast("long")).otherwise(F.col("n_chars"))
    return placed.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])
