"""Language identification by hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters'
vectors, each permuted (rotated) by its place. A text's vector bundles (adds) those of its n-grams; a
language's prototype adds the unit vectors of its texts. A text gets the language whose prototype has
the highest cosine with the text's vector; that cosine, at least 0, is the score.

Letters are lowered, every run of other characters is one space. A text that is null or has no letter
is `und` with score 0, and so is every text when nothing could be learned. Ties go to the language
that sorts first. Only the text decides; extra columns are kept, repeated rows treated one by one.

A cosine is noise below some 0.1: vectors of unrelated n-grams differ from a right angle by about
1 / sqrt(`DIMENSIONS`), and a short text holds few of its language's n-grams. So what is asked of a text
to be taken for language grows with the letters of its distinct words, up to `LONG`; and of a text that
does not reach the full cosine, at least half of those letters must be letters of a learned language.

The prototypes are learned from at most `per_language` texts of each language (more or fewer by
chance), those whose hash of doc_id is lowest: a bounded sample that is the same in every run.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterscope.llm.shared import held_out, steps, text_of

DIMENSIONS = 1024
GRAM = 3
PER_LANGUAGE = 4000
SEED = 20_240_201
#: n-grams whose vectors are in memory at a time.
BLOCK = 8192
#: Tasks that learn; each adds up its share of the sample.
LEARNERS = 24
#: Letters in distinct words from which a text has to reach the whole cosine that is asked for.
LONG = 100
#: A letter is one of a language if more than this share of the language's sampled texts have it.
COMMON = 0.005

_SPACE = 32
_WORD = re.compile(r"[^\W\d_]+")


class Letters:
    """Symbols of code points and the symbols' vectors, made when first met."""

    def __init__(self, dimensions: int):
        lowered = np.full(0x110000, _SPACE, np.int32)
        for c in range(0x33480):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                lowered[c] = ord(low) if len(low) == 1 else c
        self.lowered = lowered
        self.index = np.full(0x110000, -1, np.int32)
        self.vectors = np.empty((0, dimensions), np.int8)

    def places(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of `vectors` for symbols."""
        new = symbols[self.index[symbols] < 0]
        if len(new):
            made = [np.random.default_rng([SEED, int(s)]).integers(0, 2, self.vectors.shape[1], np.int8) * 2 - 1 for s in new]
            self.index[new] = np.arange(len(self.vectors), len(self.vectors) + len(new))
            self.vectors = np.vstack([self.vectors, *made])
        return self.index[symbols]


_letters: dict[int, Letters] = {}


def letters(dimensions: int) -> Letters:
    if dimensions not in _letters:
        _letters[dimensions] = Letters(dimensions)
    return _letters[dimensions]


def profiles(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The texts' vectors; a row of zeros for a text without a letter."""
    known = letters(dimensions)
    out = np.zeros((len(texts), dimensions), np.float32)
    sizes = [len(t) for t in texts]
    codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le"), "<u4")
    symbols = known.lowered[codes]
    owner = np.repeat(np.arange(len(texts)), np.array(sizes) + 1)
    owner = np.append(owner, len(texts) - 1)  # the space before the first text is the one that precedes it
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != _SPACE) | (symbols[:-1] != _SPACE)
    symbols, owner = symbols[keep], owner[keep]
    if len(symbols) < GRAM:
        return out
    present = np.flatnonzero(np.bincount(symbols))
    place = known.places(present)
    dense = np.zeros(present[-1] + 1, np.int64)
    dense[present] = np.arange(len(present))
    ordinal = dense[symbols]
    n = len(ordinal) - GRAM + 1
    grams = np.zeros(n, np.int64)
    inside = np.ones(n, bool)
    for k in range(GRAM):
        grams = grams * len(present) + ordinal[k : k + n]
        if 0 < k < GRAM - 1:  # a space inside, not at an edge, joins two words: not an n-gram
            inside &= symbols[k : k + n] != _SPACE
    grams, owner = grams[inside], owner[GRAM // 2 : GRAM // 2 + n][inside]
    if not len(grams):
        return out
    if len(present) ** GRAM <= 1 << 22:
        distinct = np.flatnonzero(np.bincount(grams, minlength=1))
        column = np.zeros(distinct[-1] + 1, np.int64)
        column[distinct] = np.arange(len(distinct))
        column = column[grams]
    else:
        distinct, column = np.unique(grams, return_inverse=True)
    for first in range(0, len(distinct), BLOCK):
        block = distinct[first : first + BLOCK]
        vectors = np.ones((len(block), dimensions), np.int8)
        rest = block.copy()
        for k in range(GRAM):  # the last letter is not rotated, the one before by one, and so on
            vectors *= np.roll(known.vectors[place[rest % len(present)]], k, axis=1)
            rest //= len(present)
        mine = slice(None) if len(distinct) <= BLOCK else (column >= first) & (column < first + BLOCK)
        cells = owner[mine] * len(block) + (column[mine] - first)
        counts = np.bincount(cells, minlength=len(texts) * len(block)).reshape(len(texts), len(block))
        out += counts.astype(np.float32) @ vectors.astype(np.float32)
    return out


@dataclass(frozen=True)
class Prototypes:
    """Unit vectors of languages, in the order of their names, and the letters of all of them."""

    names: tuple[str, ...]
    vectors: np.ndarray
    alphabet: frozenset[int] = frozenset()

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        vectors = profiles(texts, self.vectors.shape[1])
        size = np.sqrt((vectors * vectors).sum(1))
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        cosine = (vectors @ self.vectors.T) / np.maximum(size, 1e-9)[:, None]
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(float), 0.0, 1.0)
        empty = np.array([not any(map(str.isalpha, t)) for t in texts]) | (size == 0)
        score[empty] = 0.0
        return ["und" if e else self.names[b] for e, b in zip(empty, best, strict=True)], score

    def accepts(self, texts: list[str], least: float) -> list[bool]:
        """Whether texts are in a learned language: their score is `least`, or a share of it for short ones."""
        lowered = letters(self.vectors.shape[1]).lowered
        out = []
        for t, name, score in zip(texts, *self.predict(texts), strict=True):
            if name != "und" and score < least:
                own = [lowered[ord(c)] for word in set(_WORD.findall(t.lower())) for c in word]
                learned = sum(c in self.alphabet for c in own)
                out.append(bool(2 * learned >= len(own) and score * LONG >= least * min(len(own), LONG)))
            else:
                out.append(name != "und")
        return out


def learn(texts: DataFrame, dimensions: int = DIMENSIONS, per_language: int = PER_LANGUAGE) -> Prototypes:
    """Prototypes from `doc_id`, `text` and `lang`; rows without text or lang teach nothing.

    The driver receives a number per language, the prototypes and counts of letters: the languages are the
    distinct values of `lang`, and their number and that of letters bound these.
    """
    texts = texts.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    texts = texts.where("text is not null and lang is not null")
    counts = {r.lang: r.n for r in texts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Prototypes((), np.zeros((0, dimensions), np.float32))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = texts.where(draw < share[F.col("lang")]).repartition(LEARNERS, "doc_id")

    # Places from `dimensions` on are letters, the last one counts texts.
    last = dimensions + 0x110000

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        having: dict[str, Counter[int]] = {}
        lowered = letters(dimensions).lowered
        for batch in batches:
            strings, names = text_of(batch, "text"), np.array(batch.column("lang").to_pylist(), object)
            for first, end in steps([t.encode() for t in strings]):
                vectors = profiles(strings[first:end], dimensions)
                vectors /= np.maximum(np.sqrt((vectors * vectors).sum(1)), 1e-9)[:, None]
                for name in set(names[first:end]):
                    own = vectors[names[first:end] == name].sum(0, dtype=np.float64)
                    sums[name] = sums[name] + own if name in sums else own
                for t, name in zip(strings[first:end], names[first:end], strict=True):
                    found = {int(lowered[ord(c)]) for c in set(t)} - {_SPACE}
                    having.setdefault(name, Counter()).update([last, *(dimensions + c for c in found)])
        for name, v in sums.items():
            k, n = zip(*having[name].items(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (dimensions + len(k)), pa.string()), pa.array([*range(dimensions), *k], pa.int32()), pa.array([*v, *n], pa.float64())],
                names=["lang", "k", "x"],
            )

    parts = sample.mapInArrow(add_up, "lang string, k int, x double")
    summed = parts.groupBy("lang", "k").agg(F.sum("x").alias("x"))
    names = tuple(sorted(counts))
    row = {name: i for i, name in enumerate(names)}
    vectors = np.zeros((len(names), dimensions))
    having = []
    sampled: dict[str, float] = {}
    for r in summed.collect():
        if r.k < dimensions:
            vectors[row[r.lang], r.k] = r.x
        elif r.k < last:
            having.append(r)
        else:
            sampled[r.lang] = r.x
    alphabet = frozenset(r.k - dimensions for r in having if r.x > COMMON * sampled[r.lang])
    # Sums of partial sums may differ in the last digits from run to run; eight digits do not.
    vectors = np.round(vectors / np.maximum(np.sqrt((vectors * vectors).sum(1)), 1e-9)[:, None], 8)
    return Prototypes(names, vectors.astype(np.float32), alphabet)


def predicted(text: Column, model: Prototypes) -> Column:
    """struct(lang_pred, score) of a text."""

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            names: list[str] = []
            scores = [np.zeros(0)]
            for first, last in steps([t.encode() for t in texts]):
                some, score = model.predict(texts[first:last])
                names += some
                scores.append(score)
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(np.concatenate(scores), pa.float64())], names=["lang_pred", "score"]
            )

    predict.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(predict, "struct<lang_pred:string,score:double>")(text.cast("string"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learned from the rows that are not held out."""
    out = held_out(F.col("doc_id"), 4, 2)
    model = learn(docs.where(~out))
    return docs.select("doc_id", out.alias("held_out"), predicted(F.col("text"), model).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score"
    )


def accepted(docs: DataFrame, least: float) -> DataFrame:
    """The rows, with all their columns, whose text is in a language by this score (see `Prototypes.accepts`).

    Learned from the rows' own `lang`.
    """
    model = learn(docs.select("doc_id", "text", "lang"))

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            yield pa.array([x for a, b in steps([t.encode() for t in texts]) for x in model.accepts(texts[a:b], least)], pa.bool_())

    judge.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.where(F.arrow_udf(judge, "boolean")(F.col("text").cast("string")))
