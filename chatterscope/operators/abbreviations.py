"""Abbreviations learned from the texts themselves, and tokens that keep their periods.

A word that nearly always ends in a period is one, the shorter and the fuller of inner periods the more
surely: the published unsupervised score (a likelihood ratio of word and period, times factors of length, inner
periods and occurrences without a period). Words are counted with map-side combine; nothing else is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterscope.functions import text as tx
from chatterscope.operators.joins import attach

#: The published threshold, and how often an abbreviation is expected to have its period.
THRESHOLD, EXPECTED = 0.3, 0.99
#: Stands for a kept period while a text is cut; no character, by the standard.
_MARK = "\ufdd0"


def pieces(text: Column) -> Column:
    """The text cut after each whitespace character; joined, the pieces are the text again."""
    return F.split(text, f"(?<=[{tx.WHITESPACE}])")


def _core(piece: Column) -> Column:
    """Lower-case, without marks at the edges other than periods at the end."""
    return F.regexp_replace(F.lower(piece), r"\A[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+\z", "")


def _word(core: Column) -> Column:
    return F.regexp_replace(core, r"\.+\z", "")


def _stopped(core: Column) -> Column:
    """Whether it ends in one period."""
    return core.rlike(r"[\p{L}\p{N}]\.\z")


def scored_words(texts: DataFrame, text: str) -> DataFrame:
    """`(word, n, stopped, score)` of each word that ends in a single period somewhere; words hold a letter.

    n: how often the word occurs; stopped: how often with its period. Null and empty texts hold no words;
    without any word there are no rows. A text that occurs again counts again.
    """
    # Pieces are counted before they are looked into: few of them are distinct.
    piece = texts.select(F.explode(tx.split_words(F.col(text))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    each = piece.select(_core(F.col("piece")).alias("core"), "n")
    words = each.select(_word(F.col("core")).alias("word"), "n", _stopped(F.col("core")).alias("stop")).where(F.col("word").rlike(r"\p{L}"))
    counted = words.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("stopped"))
    share = counted.agg((F.sum("stopped") / F.sum("n")).alias("share")).scalar()
    n, k = F.col("n"), F.col("stopped")
    length = F.length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.length("word") - length

    def log_likelihood(p: Column) -> Column:
        return k * F.log(p) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(F.lit(0.0))

    ratio = -2 * (log_likelihood(F.col("share")) - log_likelihood(F.lit(EXPECTED)))
    weight = F.exp(-length.cast("double")) * (inner + 1) * F.pow(length.cast("double"), (k - n).cast("double"))
    found = counted.where(k > 0).withColumn("share", share)
    return found.select("word", "n", "stopped", (ratio * weight).alias("score"))


def abbreviations(texts: DataFrame, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """`word`: the learned abbreviations, without their last period."""
    return scored_words(texts, text).where(F.col("score") >= threshold).select("word")


def kept_tokens(texts: DataFrame, known: DataFrame, key: str, text: str, name: str = "tokens") -> DataFrame:
    """Add the tokens of `functions.text.tokens`, with the period of a known abbreviation left on its word
    wherever more text follows; `key` is unique, `known` has one column `word`.

    Only words with a period are looked up, and positions come back by key. A text that holds U+FDD0 is cut
    without abbreviations; a null text has null tokens.
    """
    cut = pieces(F.col(text))

    def candidates(words: Column) -> Column:
        """The words of a text without the whitespace behind it; they stand where its pieces do."""

        def candidate(word: Column, at: Column) -> Column:
            ends = word.endswith(".") & (at < F.size(words) - 1)
            return F.when(ends & _stopped(_core(word)), F.struct(at.alias("at"), _word(_core(word)).alias("word")))

        return F.array_compact(F.transform(words, candidate))

    words = F.split(tx.spaced(F.rtrim(F.col(text), F.lit(tx.WHITESPACE))), " ")
    found = texts.where(~F.contains(text, F.lit(_MARK))).select(F.col(key), F.explode(tx.bound(words, candidates)).alias("c"))
    sought = found.select(key, "c.*")
    hits = attach(sought, known, ["word"], [key, "at"], "left_semi").groupBy(key).agg(F.array_sort(F.collect_list("at")).alias("_kept"))
    kept = F.col("_kept")

    def marked(cut: Column) -> Column:
        """One stretch for each kept period, which it ends with, and the rest: linear in the text."""

        def stretch(at: Column, j: Column) -> Column:
            begin = F.coalesce(F.get(kept, j - 1) + 1, F.lit(0))
            whole = F.array_join(F.slice(cut, begin + 1, at - begin + 1), "")
            return F.regexp_replace(whole, rf"\.(?=[{tx.WHITESPACE}]*\z)", _MARK)

        rest = F.array_join(F.slice(cut, F.array_max(kept) + 2, F.size(cut)), "")
        return F.concat(F.array_join(F.transform(kept, stretch), ""), rest)

    joined = texts.join(hits, key, "left")
    safe = F.when(kept.isNull(), F.col(text)).otherwise(tx.bound(cut, marked))
    back = F.transform("_tokens", lambda t: F.replace(t, F.lit(_MARK), F.lit(".")))
    return (
        joined.withColumn("_tokens", tx.tokens(safe))
        .withColumn(name, F.when(kept.isNull(), F.col("_tokens")).otherwise(back))
        .drop("_tokens", "_kept")
    )
