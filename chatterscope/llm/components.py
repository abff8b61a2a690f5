"""Connected components by contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterscope.llm.shared import stored


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (node, label) after `links` (a, b) between nodes: each label becomes the least one that
    is reached through links.

    Every label points to its least neighbour; pointers are followed to their ends, doubling each time;
    then links join the ends only, and what is left is contracted again.
    """
    ends = labels.select(F.col("node").alias("a"), F.col("label").alias("u"))
    edges = links.join(ends, "a").join(ends.withColumnsRenamed({"a": "b", "u": "v"}), "b").where("u <> v")
    edges = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    moves = None
    while not edges.isEmpty():
        # u < v: a label with a smaller neighbour points to the least of them, others stay.
        points = stored(edges.groupBy(F.col("v").alias("old")).agg(F.min("u").alias("new")), "points")
        while True:
            after = points.select(F.col("old").alias("new"), F.col("new").alias("next"))
            jumped = stored(
                points.join(after, "new", "left").select("old", F.coalesce("next", "new").alias("new"), F.col("next").isNotNull().alias("moved")),
                "points",
            )
            points = jumped.select("old", "new")
            if jumped.where("moved").isEmpty():
                break
        moves = points if moves is None else _then(moves, points)
        to_u = points.withColumnsRenamed({"old": "u", "new": "u2"})
        to_v = points.withColumnsRenamed({"old": "v", "new": "v2"})
        edges = edges.join(to_u, "u", "left").join(to_v, "v", "left").select(
            F.coalesce("u2", "u").alias("u"), F.coalesce("v2", "v").alias("v")
        )
        edges = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        edges = stored(edges, "edges")
    if moves is None:
        return labels
    found = labels.join(moves.withColumnRenamed("old", "label"), "label", "left")
    return stored(found.select("node", F.coalesce("new", "label").alias("label")), "labels")


def _then(moves: DataFrame, points: DataFrame) -> DataFrame:
    """`moves`, each followed by the move of `points` from where it ended, and the moves that start there."""
    after = points.select(F.col("old").alias("new"), F.col("new").alias("next"))
    return moves.join(after, "new", "left").select("old", F.coalesce("next", "new").alias("new")).unionByName(points)
