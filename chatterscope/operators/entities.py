"""Named entities in text order: by gazetteer, by word shape, or by a plugged-in tagger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterscope.functions.text import bound, strip, tokens
from chatterscope.operators.joins import dictionary_join, measured

ENTITY = "struct<pos:int,phrase:string,label:string>"


OVERLAPS = ("any", "kept")


def gazetteer_matches(
    texts: DataFrame, gazetteer: DataFrame, key: str, text: str, overlap: str = "any"
) -> DataFrame:
    """One row per entity found: `_id, pos, phrase, label`.

    `gazetteer(phrase, label)`: tokens joined by one space; of a repeated phrase the first label by
    name counts. Of the phrases that start at one token the longest stands; a match that begins
    before the end of one that started earlier is dropped: of `any` earlier match, or only of one that
    was `kept`, as a scan from the left leaves them. Tokens that open no phrase are dropped by
    a join before what follows them is put together, and each opening token is followed only for the
    lengths of phrases that it opens, so one long phrase does not widen other rows.
    """
    if overlap not in OVERLAPS:
        raise ValueError(f"overlap must be one of {OVERLAPS}")
    phrases = gazetteer.groupBy("phrase").agg(F.min("label").alias("label"))
    phrases = phrases.withColumn("n", F.size(F.split("phrase", " ")))
    small, (longest,) = measured(phrases, F.max("n"))
    opening = F.substring_index("phrase", " ", 1).alias("t0")
    openings = phrases.groupBy(opening).agg(F.array_sort(F.collect_set("n")).alias("sizes"))
    toks = F.col("_tokens")
    starts = (
        texts.select(F.col(key).alias("_id"), tokens(F.col(text)).alias("_tokens"))
        .select("_id", "_tokens", F.posexplode_outer(toks).alias("pos", "t0"))
        .where(F.col("t0").isNotNull())
        .select("_id", "pos", "t0", F.slice(toks, F.col("pos") + 1, longest or 1).alias("_ahead"))
    )
    starts = dictionary_join(starts, openings, "t0", "inner", small, ["_id", "pos"])
    ahead = F.col("_ahead")
    fits = F.filter("sizes", lambda n: n <= F.size(ahead))
    grams = F.transform(fits, lambda n: F.array_join(F.slice(ahead, F.lit(1), n), " "))
    candidates = starts.select("_id", "pos", F.explode(grams).alias("phrase"))
    hits = dictionary_join(candidates, phrases, "phrase", "inner", small, ["_id", "pos"])
    in_order = Window.partitionBy("_id").orderBy("pos", F.col("n").desc())
    earlier_end = F.max(F.col("pos") + F.col("n")).over(
        in_order.rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = hits.withColumn("_before", F.lag("pos").over(in_order)).withColumn("_end", earlier_end)
    free = F.col("_before").isNull() | (F.col("_end") <= F.col("pos"))
    longest = ranked.where(F.col("_before").isNull() | (F.col("_before") != F.col("pos")))
    if overlap == "any":
        return longest.where(free).select("_id", "pos", "phrase", "label")
    # Matches that hang together are folded; a run of them begins where none before reaches.
    run = F.sum(F.when(free, 1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    runs = longest.withColumn("_run", run).groupBy("_id", "_run").agg(
        F.array_sort(F.collect_list(F.struct("pos", "n", "phrase", "label"))).alias("_matches")
    )
    return runs.select("_id", F.explode(_scanned(F.col("_matches"))).alias("m")).select("_id", "m.pos", "m.phrase", "m.label")


def _scanned(matches: Column) -> Column:
    """Of matches in text order those that begin at or after the end of the last one taken."""
    end = lambda m: m["pos"] + m["n"]
    first = F.element_at(matches, 1)
    state = lambda until, taken: F.struct(until.alias("until"), taken.alias("taken"))
    return F.aggregate(
        F.slice(matches, 2, F.size(matches)),
        state(end(first), F.array(first)),
        lambda a, m: F.when(m["pos"] >= a["until"], state(end(m), F.array_append(a["taken"], m))).otherwise(a),
        lambda a: a["taken"],
    )


def entities(texts: DataFrame, gazetteer: DataFrame, key: str, text: str, overlap: str = "any") -> DataFrame:
    """`(key, entities)` for the texts with at least one match, entities in text order.

    The collected list is bounded by the words of one text.
    """
    found = gazetteer_matches(texts, gazetteer, key, text, overlap)
    return _per_text(found, key)


def _per_text(found: DataFrame, key: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("pos", "phrase", "label")))
    return found.groupBy("_id").agg(listed.alias("entities")).withColumnRenamed("_id", key)


def shape_entities(text: Column) -> Column:
    """Maximal runs of capitalised tokens that do not open the text or a sentence. Row-local; the
    tokens are bound, so that a text is tokenised once and not once for each of its words."""

    def marked(toks: Column) -> Column:
        def capital_or_break(word: Column, i: Column) -> Column:
            previous = F.get(toks, i - 1)
            inner = previous.isNotNull() & ~previous.isin(".", "!", "?")
            return F.when(inner & word.rlike(r"^\p{Lu}"), word).otherwise("\n")

        return F.array_join(F.transform(toks, capital_or_break), " ")

    runs = F.split(bound(tokens(text), marked), "\n")
    return F.filter(F.transform(runs, strip), lambda r: r != "")


#: A tagger is given no more texts, and no more characters of them unless one text has more, at a time.
PIECE_TEXTS, PIECE_CHARS = 512, 1 << 20
#: What it makes of pieces is handed on in tables of so many rows or a few more.
HANDED_ROWS = 10_000


Tagger = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def isolated(tagger: Tagger) -> Tagger:
    """`tagger`, kept running when it fails on a text: that text alone gives a row with `failed`.

    The tagger runs on as long as it succeeds, so what it sets up is set up once. Where it fails, the
    batch that it was at is halved until the single text is found, and the tagger begins anew with the next
    batch. A batch's rows must come before the next batch is asked for. The driver or a lost executor is no
    failure of a text: only what the tagger itself raises is caught.
    """

    def whole(frame: pd.DataFrame) -> list[pd.DataFrame]:
        try:
            return list(tagger(iter([frame])))
        except Exception:
            return halved(frame)

    def halved(frame: pd.DataFrame) -> list[pd.DataFrame]:
        """Of a batch that failed."""
        if len(frame) == 1:
            return [pd.DataFrame({"text_key": frame["text_key"], "pos": [-1], "phrase": [None], "label": [None], "failed": [True]})]
        half = len(frame) // 2
        return whole(frame.iloc[:half]) + whole(frame.iloc[half:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: list[pd.DataFrame] = []  # the batch that the tagger was given last
        found: list[pd.DataFrame] = []  # what it has made of it so far
        done: list[pd.DataFrame] = []  # what it has made of batches before

        def feed() -> Iterator[pd.DataFrame]:
            for frame in frames:
                done.extend(found)
                found.clear()
                at[:] = [frame]
                yield frame
            at.clear()

        while True:
            at.clear()
            made = tagger(feed())
            try:
                for frame in made:
                    found.append(frame)
                    yield from done
                    done.clear()
                done.extend(found)
                found.clear()
                at.clear()
            except Exception:
                if not at:  # at its end, with no text to blame
                    raise
                found.clear()
                done.extend(halved(at[0]))
            yield from done
            done.clear()
            if not at:
                return

    return run


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same texts, few at a time: what a tagger makes of a piece is all that a task holds of it, however
    many rows Spark hands over at once."""
    for frame in frames:
        ends = np.cumsum([len(t) for t in frame["text"]])
        begin = chars = 0
        while begin < len(frame):
            end = min(begin + PIECE_TEXTS, max(begin + 1, int(np.searchsorted(ends, chars + PIECE_CHARS, "right"))))
            yield frame.iloc[begin:end].reset_index(drop=True)
            begin, chars = end, int(ends[end - 1])


def _with_failed(tagger: Tagger) -> Tagger:
    """`tagger` over pieces, isolated; every row says whether its text `failed`. Small tables are handed on
    together: each has its price on the way back to Spark."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for frame in isolated(tagger)(_pieces(frames)):
            if frame.empty:
                continue
            held.append(frame)
            rows += len(frame)
            if rows >= HANDED_ROWS:
                yield _together(held)
                held, rows = [], 0
        if held:
            yield _together(held)

    return run


def _together(frames: list[pd.DataFrame]) -> pd.DataFrame:
    """Frames of one tagger as one, each row with its mark."""
    columns = ["text_key", "pos", "phrase", "label"]
    marks = [mark for f in frames for mark in (f["failed"] if "failed" in f else [False] * len(f))]
    values = {c: [v for f in frames for v in f[c]] for c in columns}
    return pd.DataFrame(values).assign(failed=np.array(marks, dtype=bool))


def plugged_entities(
    texts: DataFrame, tagger: Tagger, key: str, text: str
) -> DataFrame:
    """Entities from a user's tagger over Arrow batches: (text_key, text) in,
    (text_key, pos, phrase, label) out. A phrase may carry tags (`word/TAG word/TAG`).

    A text on which the tagger fails has no entities and is marked `failed`; see `isolated`.
    """
    schema = f"text_key {texts.schema[key].dataType.simpleString()}, pos int, phrase string, label string, failed boolean"
    pairs = texts.select(F.col(key).alias("text_key"), F.col(text).alias("text"))
    found = pairs.where(F.col("text").isNotNull()).mapInPandas(_with_failed(tagger), schema)
    listed = F.array_sort(F.collect_list(F.when(~F.col("failed"), F.struct("pos", "phrase", "label"))))
    return found.groupBy("text_key").agg(listed.alias("entities"), F.bool_or("failed").alias("failed")).withColumnRenamed("text_key", key)


def as_words(found: Column) -> Column:
    """Comment rendering: the words only."""
    return F.coalesce(F.array_join(F.transform(found, lambda e: e["phrase"]), ", "), F.lit(""))


def as_brackets(found: Column) -> Column:
    """Title rendering: `(LABEL w1 w2)`."""
    one = lambda e: F.concat(F.lit("("), e["label"], F.lit(" "), e["phrase"], F.lit(")"))
    return F.coalesce(F.array_join(F.transform(found, one), ", "), F.lit(""))
