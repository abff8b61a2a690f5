"""Document fingerprints: the hashes of a text's word shingles that lie below a fixed fraction of all.

The sketch scales with the text, so the union of two sketches is the sketch of the union of their
shingles, and what a short text shares with a very long one can be estimated from both sketches.
Everything is built from DataFrame functions.

Words are lowered runs without white space; a text of one to four words has one shingle, all of them.
Null and empty texts, and those without words, have an empty sketch; so may very short texts by chance.
Two empty sketches are alike (1) if the texts are equal, else not at all (0).

For the edited texts, documents follow each other by doc_id, then by a hash of the text; after the last
comes the first. A row without doc_id has no place in that order: nothing follows it (its edited text
only loses its end, its likeness to the next is 0, or 1 if it is empty), and it follows nothing. Rows
that repeat doc_id and text follow each other. Extra columns are ignored, no rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterscope.functions.text import bound, spaced

WIDTH = 5
#: A sketch retains a shingle's hash if it is among the lowest 2^-SHIFT of all 64-bit hashes, unless given:
#: the query retains one in two, for the sake of short texts.
SHIFT = 3
#: Documents in a range of the order, about, and the most ranges; the driver receives their bounds.
RANGE_ROWS = 4000
MOST_RANGES = 16384


def sketch(text: Column, width: int = WIDTH, shift: int = SHIFT) -> Column:
    """Ascending distinct retained hashes of the text's shingles."""
    limit = -(1 << 63) + (1 << (64 - shift))
    words = F.array_remove(F.split(spaced(F.lower(text)), " +"), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda k: F.xxhash64(*[F.get(h, k + i) for i in range(width)]))
        whole = F.array(F.xxhash64(F.array_join(h, " ")))
        return F.when(F.size(h) >= width, each).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<long>"))

    return F.array_sort(F.array_distinct(F.filter(bound(hashed, shingles), lambda x: x < limit)))


def merged(*sketches: Column) -> Column:
    """The sketch of all texts' shingles together."""
    out = sketches[0]
    for s in sketches[1:]:
        out = F.array_union(out, s)
    return F.array_sort(out)


def written(s: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Estimate of |both| / |either| of the shingle sets."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(equal.cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Estimate of the share of a's shingles that b has too; null if a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def followed(docs: DataFrame, carried: list[str]) -> DataFrame:
    """`docs` (doc_id, tie, and columns of which none starts with next_), with next_<column> of the
    document that follows.

    Ranges of the order go to different tasks. Each range also gets the first document of the one after
    it, so no task sees more than a range.
    """
    ids = docs.where("doc_id is not null")
    n, least = ids.agg(F.count("*"), F.min("doc_id")).first()
    ranges = max(1, min(MOST_RANGES, math.ceil(n / RANGE_ROWS)))
    bounds: list[int] = []
    if ranges > 1:
        parts = [k / ranges for k in range(1, ranges)]
        found = ids.agg(F.percentile_approx("doc_id", parts, 20 * ranges)).first()[0]
        bounds = sorted({b for b in found if b > least})
    last = len(bounds)
    # Bounds in groups, so that a row is compared with about two square roots of their number.
    size = max(1, math.isqrt(last))
    groups = [bounds[k : k + size] for k in range(0, last, size)] or [[]]
    array = lambda xs: F.array(*map(F.lit, xs)).cast("array<long>")
    firsts, tails = array([g[0] for g in groups if g]), F.array(*map(array, groups))
    doc_id = F.col("doc_id")
    group = F.size(F.filter(firsts, lambda b: b <= doc_id))
    own = F.when(group == 0, 0).otherwise(
        (group - 1) * size + F.size(F.filter(F.get(tails, group - 1), lambda b: b <= doc_id))
    )
    # A bound is the doc_id of the first document of its range.
    starts = F.exists(F.get(tails, group - 1), lambda b: b == doc_id) & (group > 0)
    place = lambda r, ghost, after: F.struct(r.cast("int").alias("range"), F.lit(ghost).alias("ghost"), F.lit(after).alias("after"))
    places = F.array_compact(
        F.array(
            place(own, False, False),
            F.when(starts, place(own - 1, True, False)),
            F.when(doc_id == F.lit(least), place(F.lit(last), True, True)),
        )
    )
    placed = ids.withColumn("place", F.explode(places)).select("*", "place.*").drop("place")
    order = Window.partitionBy("range").orderBy("after", "doc_id", "tie")
    placed = placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    alone = docs.where("doc_id is null").select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in carried])
    return placed.where("not ghost").drop("range", "ghost", "after").unionByName(alone)


def fingerprints(docs: DataFrame, shift: int = SHIFT) -> DataFrame:
    """Every document's sketch, that of its edited text, and likenesses; all retain 2^-shift of the hashes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    own = own.select("doc_id", "text", F.xxhash64("text").alias("tie"), sketch(F.col("text"), shift=shift).alias("sketch"))
    pairs = followed(own, ["text", "sketch"])
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    replaced = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    pairs = pairs.withColumn("edited", replaced)
    pairs = pairs.withColumn("edited_sketch", sketch(F.col("edited"), shift=shift))
    none = F.array().cast("array<long>")
    return pairs.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("sketch"), F.coalesce("next_sketch", none), F.col("text") == F.coalesce("next_text", F.lit(""))).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_in_edited"),
    )
