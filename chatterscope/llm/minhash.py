"""Near duplicates by MinHash with tensored banding.

A text's set holds the hashes of its word shingles. Two collections of `m` sub-keys, each made of two
minimal hashes, replace m * m independent bands: the key of table (i, j) pairs sub-key i of the first
collection with sub-key j of the second, so 4m minimal hashes serve m * m tables of four. Two texts meet
in some table if they share a sub-key in either collection. `m` is chosen so that texts whose likeness
is just the threshold fail to meet less often than once in a million; full sets confirm every link.

Texts with equal sets are one node. Linked nodes are found without listing all pairs of a bucket: while
a bucket holds several components, its members are compared with one leader from its first component.
After some rounds with changing leaders, what is still apart is compared in blocks, member by member
across components, where only links are written down. Only pairs already in one component are never compared, so no link between
components is lost.

Null texts are empty; empty texts (or such without words) are linked with nothing and stay. A component
is named by its smallest doc_id, null only if it has no other. Repeated rows have equal sets and fall
into one component. Extra columns are ignored or kept, no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterscope.llm import words
from chatterscope.llm.components import merged
from chatterscope.llm.shared import release, releases, small, steps, stored, unused

#: Share of pairs just at the threshold that may meet in no table.
MISSED = 1e-6
#: Rounds with one leader to a bucket before the rest is compared in blocks.
LEADER_ROUNDS = 2
#: Shingles of the sets in a block, about.
BLOCK = 1 << 20
#: Sub-keys of both collections that a pair must share to be compared in blocks. Fewer than
#: this many agree with a chance of 2.3e-8 at likeness 0.85 (24 sub-keys), 1.5e-8 at 0.8 (30).
LEAST_SHARED = 5


@dataclass(frozen=True)
class Likeness:
    """Shingles of `width` words; sets are linked if parts * |both| >= share * |either|."""

    width: int
    share: int
    parts: int = 100

    @property
    def m(self) -> int:
        apart = 1 - (self.share / self.parts) ** 2
        return math.ceil(math.log(MISSED / 2) / math.log(apart))


def _factors(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_301)
    draw = lambda: rng.integers(0, 1 << 63, 4 * m, np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(), draw()


def sets_of(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes text by text, ascending; the first place and the size of each text's."""
    found, owner = words.hashes(texts, words.WHITE)
    found, owner = words.shingles(found, owner, len(texts), width)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    sizes = np.bincount(owner, minlength=len(texts))
    return found, np.cumsum(sizes) - sizes, sizes


def sub_keys(found: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """2m sub-keys of each set (a row each); `first` are the places where non-empty sets begin."""
    factor, offset = _factors(m)
    out = np.empty((len(first), 2 * m), np.uint64)
    for k in range(2 * m):
        a, b = (np.minimum.reduceat(found * factor[q] + offset[q], first) for q in (2 * k, 2 * k + 1))
        out[:, k] = words.mix(a * factor[0] + b)
    return out


def _features(like: Likeness):
    """struct(row, n, d1, d2, subs): a number of the row; its set's size, 128-bit digest, sub-keys."""

    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [t or b"" for t in batch.to_pylist()]
            n, d1, d2 = (np.zeros(len(texts), np.int64) for _ in range(3))
            subs = np.zeros((len(texts), 2 * like.m), np.uint64)
            for a, b in steps(texts):
                found, first, sizes = sets_of(texts[a:b], like.width)
                n[a:b] = sizes
                full = np.flatnonzero(sizes)
                if len(full):
                    for out, salt in ((d1, 0x5851F42D4C957F2D), (d2, 0x14057B7EF767814F)):
                        sums = np.add.reduceat(words.mix(found ^ np.uint64(salt)), first[full])
                        out[a + full] = sums.view(np.int64)
                    subs[a + full] = sub_keys(found, first[full], like.m)
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, 2 * like.m, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(subs[n > 0].view(np.int64).ravel()))
            rows = np.arange(row, row + len(texts), dtype=np.int64)
            row += len(texts)
            yield pa.StructArray.from_arrays(
                [pa.array(rows), pa.array(n), pa.array(d1), pa.array(d2), lists], names=["row", "n", "d1", "d2", "subs"]
            )

    features.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(features, "struct<row:long,n:long,d1:long,d2:long,subs:array<long>>")


def _shingled(width: int):
    """The set of a text."""

    def shingled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t or b"" for t in batch.to_pylist()]
            sets = []
            for a, b in steps(texts):
                found, first, sizes = sets_of(texts[a:b], width)
                sets += [found[i : i + k].view(np.int64) for i, k in zip(first.tolist(), sizes.tolist(), strict=True)]
            yield pa.array(sets, pa.list_(pa.int64()))

    shingled.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(shingled, "array<long>")


def _tables(nodes: DataFrame, m: int) -> DataFrame:
    """(key, node) for the tables where a node can meet another: those whose two sub-keys each
    belong to several nodes. nodes: node, subs."""
    subs = nodes.select("node", F.posexplode("subs").alias("k", "sub"))
    shared = subs.groupBy("k", "sub").agg(F.count("*").alias("n")).where("n > 1").select("k", "sub")
    live = subs.join(shared, ["k", "sub"]).groupBy("node").agg(F.collect_list(F.struct("k", "sub")).alias("live"))
    one = live.select("node", "live", F.explode(F.filter("live", lambda x: x["k"] < m)).alias("a"))
    two = one.select("node", "a", F.explode(F.filter("live", lambda x: x["k"] >= m)).alias("b"))
    return two.select(F.xxhash64("a.k", "a.sub", "b.k", "b.sub").alias("key"), "node")


def _confirmed(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The linked ones of `pairs` (a, b), by their full sets."""
    one = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    either = F.size("x") + F.size("y") - both
    return pairs.join(one, "a").join(two, "b").where(both * like.parts >= either * like.share).select("a", "b")


@dataclass
class _Unit:
    """Two blocks of the nodes that share sub-key i, or one block twice."""

    name: tuple
    rows: list[tuple]

    def links(self, m: int, like: Likeness) -> list[tuple[int, int]]:
        """One link (a, b) for each two components of the unit that have any, by full sets."""
        _, _, i, p, q = self.name
        block, node, label = (np.array([r[k] for r in self.rows], np.int64) for k in range(3))
        subs = np.stack([r[3] for r in self.rows])
        sizes = np.array([len(r[4]) for r in self.rows])
        first = np.cumsum(sizes) - sizes
        _, items = np.unique(np.concatenate([r[4] for r in self.rows]), return_inverse=True)
        names, members = np.unique(label, return_counts=True)
        # Of any two components one is not the largest: its members are compared with all others.
        few = np.flatnonzero(label != names[members.argmax()])
        todo = np.ones(len(node), bool)
        marked = np.zeros(int(items.max()) + 1, bool)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for x in few.tolist():
            todo[x] = False  # once from either side
            ok = todo & (label != label[x])
            if p != q:
                ok &= block != block[x]
            at = np.flatnonzero(ok)
            same = subs[at] == subs[x]
            # Each pair in the first sub-key that it shares, if it shares one of either collection.
            at = at[(same.sum(1) >= LEAST_SHARED) & (same[:, :m].argmax(1) == i) & same[:, m:].any(1)]
            if not len(at):
                continue
            own = items[first[x] : first[x] + sizes[x]]
            marked[own] = True
            both = np.add.reduceat(marked[items], first)[at]
            marked[own] = False
            linked = at[both * like.parts >= (sizes[at] + sizes[x] - both) * like.share]
            for y in linked.tolist():
                found.setdefault((min(label[x], label[y]), max(label[x], label[y])), (int(node[x]), int(node[y])))
        return list(found.values())


def _across(m: int, like: Likeness):
    """Links between components in each unit. Rows come unit by unit."""

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = None
        links: list[tuple[int, int]] = []
        for batch in batches:
            names = zip(*(batch.column(c).to_pylist() for c in ("k", "sub", "i", "p", "q")), strict=True)
            block, node, label = (batch.column(c).to_pylist() for c in ("block", "node", "label"))
            lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("subs"), batch.column("items"))]
            for r, name in enumerate(names):
                if unit is None or unit.name != name:
                    links += unit.links(m, like) if unit else []
                    unit = _Unit(name, [])
                subs, items = (v[at[r] : at[r + 1]].copy() for v, at in lists)
                unit.rows.append((block[r], node[r], label[r], subs, items))
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in links], schema=_LINKS)
            links = []
        if unit:
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in unit.links(m, like)], schema=_LINKS)

    return across


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _in_blocks(apart: DataFrame, nodes: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) between components among the nodes of `apart` (node, label).

    Nodes that meet in some table share a sub-key of the first collection, so its m buckets take the
    place of the m * m tables. A bucket goes to the tasks in units of two blocks of bounded size, and
    full sets are compared there: pairs are not written out, only links.
    """
    members = nodes.join(apart.select("node", "label").distinct(), "node")
    keys = members.select("node", "label", F.size("subs").alias("n"), F.posexplode("subs").alias("k", "sub")).where(f"k < {like.m}")
    sized = keys.drop("n").join(sets.select("node", F.size("items").alias("n")), "node")
    shared = sized.groupBy("k", "sub").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")
    )
    shared = shared.where("low < high").select("k", "sub", "blocks")
    placed = keys.join(shared, ["k", "sub"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "k", "sub", F.col("k").alias("i"), F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "label"
    )
    full = units.join(nodes.select("node", "subs").join(sets, "node"), "node")
    order = ["k", "sub", "p", "q"]
    return full.repartition(*order).sortWithinPartitions(*order).mapInArrow(_across(like.m, like), "a long, b long")


@releases
def linked(nodes: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """(node, label) of the nodes that may have links: the least node each can reach.

    nodes: node, subs. texts: node, text (binary), of all nodes.
    """
    tables = stored(_tables(nodes, like.m), "tables")
    labels = stored(tables.select("node").distinct().select("node", F.col("node").alias("label")), "labels")
    sets = stored(texts.join(small(labels.select("node")), "node").select("node", _shingled(like.width)(F.col("text")).alias("items")), "sets")
    for turn in range(LEADER_ROUNDS + 1):
        placed = tables.join(labels, "node")
        # The first leaders are the same in all of a group's buckets, later ones differ from bucket to bucket.
        draw = F.xxhash64("node", "key", F.lit(turn)) if turn else F.xxhash64("node")
        leads = placed.groupBy("key").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct("label", draw.alias("draw"), "node")).alias("lead")
        )
        leads = leads.where("low < high").select("key", F.col("lead.node").alias("lead"), "low")
        apart = stored(placed.join(leads, "key"), "apart")
        if apart.isEmpty():
            break
        tables = apart.select("key", "node")
        if turn < LEADER_ROUNDS:
            pairs = apart.where("label <> low").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
            links = _confirmed(pairs, sets, like)
        else:
            links = _in_blocks(apart, nodes, sets, like)
        labels = merged(labels, stored(links, "links"))
    return labels


def _labelled(docs: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame, str]:
    """`docs` stored with a column of features; (d1, d2, label) of their sets; that column's name."""
    name = unused(docs, "minhash")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = stored(docs.withColumn(name, _features(like)(text)), "shingled")
    feature = rows.select(f"{name}.*", text.alias("text")).where("n > 0")
    sets = stored(feature.groupBy("d1", "d2").agg(F.min("row").alias("node")), "classes")
    owners = sets.select(F.col("node").alias("row"))
    nodes = stored(feature.select("row", "subs").join(owners, "row").withColumnRenamed("row", "node"), "nodes")
    labels = linked(nodes, feature.select(F.col("row").alias("node"), "text"), like)
    release(nodes)
    return rows, sets.join(labels, "node", "left").select("d1", "d2", F.coalesce("label", "node").alias("label")), name


def _by_component(docs: DataFrame, like: Likeness) -> tuple[DataFrame, Column, str]:
    """Stored rows with the label of their component and the least (doc_id, row) in it."""
    rows, labels, name = _labelled(docs, like)
    own = rows.select(
        F.col(f"{name}.row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(f"{name}.n").alias("n_shingles"),
        F.col(f"{name}.d1").alias("d1"), F.col(f"{name}.d2").alias("d2"),
    )
    full = own.where("n_shingles > 0")
    # Least by doc_id, null last, then by row; first within each set, then over the component.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    of_set = full.groupBy("d1", "d2").agg(best.alias("best")).join(labels, ["d1", "d2"])
    of_label = of_set.groupBy("label").agg(F.min("best").alias("best"))
    of_set = of_set.select("d1", "d2", "label").join(of_label, "label").select("d1", "d2", "best")
    placed = full.join(of_set, ["d1", "d2"]).select("row", "doc_id", "n_shingles", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("first"))
    alone = own.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("first"))
    return rows, placed.unionByName(alone), name


def components(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every row."""
    _, placed, _ = _by_component(docs.select("doc_id", "text"), like)
    return placed.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, like: Likeness) -> DataFrame:
    """One row of each component, that of its smallest doc_id, with all columns."""
    rows, placed, name = _by_component(docs, like)
    others = stored(placed.where(F.col("row") != F.col("first")).select(F.col("row").alias(f"{name}_other")), "others")
    return rows.join(small(others), F.col(name)["row"] == F.col(f"{name}_other"), "left_anti").drop(name)
