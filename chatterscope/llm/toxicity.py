"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled texts are all that is learned from. With prior p of toxic texts,
the risk of a scorer on clean texts is what it loses when all unlabelled texts count as clean, less p
times what it loses when the toxic ones do. Where that estimate falls below zero the model has begun to
learn the unlabelled toxic texts as clean, and the step is reversed (Kiryo et al., 2017). The scorer is
logistic regression on which words and beginnings of words a text has; words are runs of letters and
digits, ASCII lowered.

Null and empty texts get the score of a text without known words. With no toxic example all score the
prior. Extra columns are ignored, repeated rows treated one by one, no rows give no rows.

The model is fitted on a bounded sample: at most about `positives` toxic and `unlabelled` other texts,
those whose hash of doc_id is lowest. Scoring covers every word of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterscope.llm import words
from chatterscope.llm.shared import held_out, steps

POSITIVES = 3000
UNLABELLED = 9000
#: Bytes of a word's beginnings that count besides the word.
PREFIXES = (4, 5, 6)
#: A word must occur in this many and in this share of the toxic examples to be looked at, and that
#: share must lie so many standard errors above or below its share among the unlabelled texts.
LEAST_TEXTS = 3
LEAST_SHARE = 0.005
LEAST_Z = 4.0
STEPS = 400
RATE = 0.05
DECAY = 1e-5
PREDICTED_AT = 0.7


def word_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct word hashes of each text, ascending."""
    found, owner = words.hashes(texts, words.MARKS, PREFIXES)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return np.split(found, np.searchsorted(owner, np.arange(1, len(texts)))) if texts else []


@dataclass(frozen=True)
class Model:
    """Weights of known words, whose hashes ascend, and the rest of the log odds."""

    known: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        found, owner = words.hashes(texts, words.MARKS, PREFIXES)
        odds = np.full(len(texts), self.bias)
        if len(self.known) and len(found):
            at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
            hit = self.known[at] == found
            cells = np.unique(owner[hit] * len(self.known) + at[hit])
            odds += np.bincount(cells // len(self.known), self.weights[cells % len(self.known)], len(texts))
        return _sigmoid(odds)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """A model from the word sets of toxic and of unlabelled texts."""
    start = float(np.log(prior / (1 - prior)))
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), start)
    if not positive or not any(map(len, unlabelled)):
        return nothing
    seen, count = np.unique(np.concatenate(positive), return_counts=True)
    other, other_count = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.minimum(np.searchsorted(other, seen), len(other) - 1)
    elsewhere = np.where(other[at] == seen, other_count[at], 0)
    n, m = len(positive), len(unlabelled)
    pooled = (count + elsewhere + 1) / (n + m + 2)
    z = (count / n - elsewhere / m) / np.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    known = seen[(count >= max(LEAST_TEXTS, LEAST_SHARE * n)) & (np.abs(z) >= LEAST_Z)]
    if not len(known):
        return nothing

    def sparse(sets):
        rows = [np.flatnonzero(np.isin(known, s, assume_unique=True)) for s in sets]
        return np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    (pc, pr), (uc, ur) = sparse(positive), sparse(unlabelled)
    weights, bias = np.zeros(len(known)), start
    first, second = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for step in range(1, STEPS + 1):
        p_sig = _sigmoid(bias + np.bincount(pr, weights[pc], n))
        u_sig = _sigmoid(bias + np.bincount(ur, weights[uc], m))
        # The sigmoid loss: as toxic 1 - sigmoid, as clean sigmoid; both have this slope but for the sign.
        p_slope, u_slope = prior * p_sig * (1 - p_sig) / n, u_sig * (1 - u_sig) / m
        if u_sig.mean() - prior * p_sig.mean() >= 0:
            p_slope = -2 * p_slope
        else:
            u_slope = -u_slope
        slope = np.empty(len(known) + 1)
        slope[:-1] = np.bincount(pc, p_slope[pr], len(known)) + np.bincount(uc, u_slope[ur], len(known)) + DECAY * weights
        slope[-1] = p_slope.sum() + u_slope.sum()
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Model(known, weights, float(bias))


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from `labels` (doc_id, toxic) and the texts of `docs`; both without held-out rows.

    The prior is the share of toxic ones among the labels. The driver receives the ids of the toxic
    sample, and the word sets of the whole sample; `positives` and `unlabelled` bound both.
    """
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    judged = labels.where("doc_id is not null and toxic is not null")
    n, toxic = judged.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    toxic = toxic or 0
    prior = min(max((toxic + 1) / (n + 2), 1e-4), 0.9)
    ids = [
        r.doc_id
        for r in judged.where((F.col("toxic") == 1) & (draw <= min(1.0, positives / max(toxic, 1)))).select("doc_id").distinct().collect()
    ]
    share = min(1.0, unlabelled / max(docs.count(), 1))
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], "wanted long"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    texts = texts.where("doc_id is not null and text is not null")
    sample = texts.join(wanted, F.col("doc_id") == F.col("wanted"), "left").where(
        F.col("wanted").isNotNull() | (draw <= share)
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text").to_pylist()
            found = [s.view(np.int64) for a, b in steps(raw) for s in word_sets(raw[a:b])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), batch.column("drawn"), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "toxic", "drawn", "words"],
            )

    rows = (
        sample.select("doc_id", F.col("wanted").isNotNull().alias("toxic"), (draw <= share).alias("drawn"), "text")
        .mapInArrow(sets, "doc_id long, toxic boolean, drawn boolean, words array<long>")
        .toArrow()
    )
    # The same order in every run, whatever order the tasks end in.
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    column = rows.column("words")
    found = [np.asarray(column[int(i)].values, np.int64).view(np.uint64) for i in order]
    is_toxic, drawn = rows.column("toxic").to_numpy()[order], rows.column("drawn").to_numpy()[order]
    return fit([f for f, t in zip(found, is_toxic, strict=True) if t], [f for f, u in zip(found, drawn, strict=True) if u], prior)


def scored(text: Column, model: Model) -> Column:
    """The score of a text, 0 to 1."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            raw = [t or b"" for t in batch.to_pylist()]
            yield pa.array(np.concatenate([np.zeros(0), *(model.score(raw[a:b]) for a, b in steps(raw))]))

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "double")(text.cast("string").cast("binary"))


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learned from what is not held out."""
    out = held_out(F.col("doc_id"), 3, 1)
    model = learn(docs.where(~out), labels.where(~out))
    found = docs.select("doc_id", out.alias("held_out"), scored(F.col("text"), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= PREDICTED_AT).cast("int"))
