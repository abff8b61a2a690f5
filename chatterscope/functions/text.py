"""Text normalisation, tokens, lexical diversity, leading bigrams and number formatting.

Everything here is a composition of built-in expressions, so it runs inside the scan stage
without a shuffle and without a Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace.
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# ASCII characters that are neither word characters nor whitespace.
_ASCII_MARKS = "".join(
    c for c in map(chr, range(128)) if not (c.isalnum() or c == "_" or c in WHITESPACE)
)


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (plain `trim` removes spaces only)."""
    return F.trim(text, F.lit(WHITESPACE))


def spaced(text: Column) -> Column:
    """Every whitespace character as a plain space, so that later patterns stay simple and fast."""
    return F.translate(text, WHITESPACE, " " * len(WHITESPACE))


def normalized(text: Column) -> Column:
    """Strip and lower-case: the form in which duplicates are compared."""
    return F.lower(strip(text))


def _words_only(text: Column) -> Column:
    """Lower-case with nothing but word characters and spaces. ASCII marks are dropped by the same
    `translate` that evens out whitespace; the pattern is left with the rare other symbols."""
    ascii_clean = F.translate(F.lower(text), WHITESPACE + _ASCII_MARKS, " " * len(WHITESPACE))
    return F.regexp_replace(ascii_clean, r"[^\x00-\x7f\p{L}\p{N}]+", "")


def cleaned(text: Column) -> Column:
    """Lower-case, drop everything but word characters and whitespace, collapse whitespace."""
    return F.trim(F.regexp_replace(_words_only(text), " +", " "))


def split_words(text: Column) -> Column:
    """Split on whitespace runs, without empty pieces."""
    return F.array_remove(F.split(spaced(text), " "), "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), 0)


def _replace_where(text: Column, marks: Sequence[str], pattern: str, replacement: str) -> Column:
    """Apply a pattern to the texts that hold one of its marks; most texts skip the scan."""

    def guarded(t: Column) -> Column:
        held = reduce(lambda x, y: x | y, (F.contains(t, F.lit(m)) for m in marks))
        return F.when(held, F.regexp_replace(t, pattern, replacement)).otherwise(t)

    return bound(text, guarded)


# The tokenizer's quotes and replacement patterns, in order of application, each with
# marks of which a text must hold one. The first group sees the raw text, the second the text with
# plain spaces; what results is split on spaces. Quotes outside ASCII are padded literally: inside a
# character class they slow every pattern down.
OPENING_QUOTES = ("«", "“", "‘", "„")
CLOSING_QUOTES = ("»", "”", "’")
QUOTE_PATTERNS = (
    ("`", r"(`+)", " $1 "),
    ('"', r'(^|[ (\[{<])"', "$1 `` "),
)
TOKEN_PATTERNS = (
    (".", r"""([^. ])\.((?:["')\]}>]|»|”|’)*)( |$)""", "$1 . $2 $3"),
    (":,", r"([:,])([^\d]|$)", " $1 $2"),
    (".-;@#$%&?!*[](){}<>", r"(\.\.+|--|[;@#$%&?!*\[\](){}<>])", " $1 "),
    ('"', r'"', " '' "),
    ("'", r"([^' ])('[sSmMdD]?)( |$)", "$1 $2 $3"),
    ("'", r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T)( |$)", "$1 $2 $3"),
)
FUSED_WORDS = ("cannot", "gimme", "lemme", "gonna", "wanna", "gotta")
FUSED_PATTERN = (r"(?i)\b(?:(can)(not)|(gim|lem)(me)|(gon|wan)(na)|(got)(ta))\b", "$1$3$5$7 $2$4$6$8")


def _split_fused(text: Column) -> Column:
    def held(lower: Column) -> Column:
        return reduce(lambda x, y: x | y, (F.contains(lower, F.lit(w)) for w in FUSED_WORDS))

    def guarded(t: Column) -> Column:
        return F.when(bound(F.lower(t), held), F.regexp_replace(t, *FUSED_PATTERN)).otherwise(t)

    return bound(text, guarded)


def tokens(text: Column) -> Column:
    """Treebank-style word tokens of raw text: punctuation and clitics become tokens."""
    for quote in OPENING_QUOTES:
        text = F.replace(text, F.lit(quote), F.lit(f" {quote} "))
    for marks, pattern, replacement in QUOTE_PATTERNS:
        text = _replace_where(text, marks, pattern, replacement)
    text = spaced(text)
    for marks, pattern, replacement in TOKEN_PATTERNS:
        text = _replace_where(text, marks, pattern, replacement)
    text = _split_fused(text)
    for quote in CLOSING_QUOTES:
        text = F.replace(text, F.lit(quote), F.lit(f" {quote} "))
    return F.array_remove(F.split(text, " "), "")


def clean_tokens(text: Column) -> Column:
    """Tokens of `cleaned` text: no punctuation is left, so only fused words need splitting."""
    return F.array_remove(F.split(_split_fused(_words_only(text)), " "), "")


def distinct_ratio(toks: Column) -> Column:
    """Distinct tokens over tokens, 0.0 when there are none."""

    def ratio(t: Column) -> Column:
        n = F.size(t)
        share = F.size(F.array_distinct(t)).cast("double") / n
        return F.when(t.isNotNull(), F.when(n > 0, share).otherwise(F.lit(0.0)))

    return bound(toks, ratio)


def diversity_label(score: Column, has_text: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit(None).cast("string"))
        .when(~has_text, "No text")
        .when(score > 0.7, "Highly diverse")
        .when(score > 0.4, "Moderately diverse")
        .otherwise("Less diverse")
    )


def lexical_diversity(text: Column) -> Column:
    """struct(score, label) over cleaned text. The label compares the unrounded score. Tokens and score are
    bound: projections that look into the struct would cut the text once for each time they do."""

    def measured(toks: Column) -> Column:
        def labelled(score: Column) -> Column:
            return F.struct(score.alias("score"), diversity_label(score, F.size(toks) > 0).alias("label"))

        return bound(distinct_ratio(toks), labelled)

    return bound(clean_tokens(text), measured)


def opening_tokens(text: Column, n: int = 6) -> Column:
    """Tokens of the text's first n whitespace words: its own first tokens, n of them at least where it has
    as many. No token or pattern reaches over whitespace, and every word makes a token or more."""
    space, word = (f"[{c}{WHITESPACE}]" for c in ("", "^"))
    return tokens(F.regexp_extract(text, rf"\A{space}*+(?:{word}++{space}*+){{0,{n}}}", 0))


def leading_bigrams(toks: Column, n: int = 5) -> Column:
    """The first n adjacent pairs, in text order."""

    def pairs(head: Column) -> Column:
        joined = F.transform(F.slice(head, 2, n), lambda word, i: F.concat_ws(" ", F.get(head, i), word))
        return F.array_join(joined, ", ")

    return bound(F.slice(toks, 1, n + 1), pairs)


def fixed_point(x: Column, digits: int) -> Column:
    """Format |x| <= 1 with `digits` decimals, rounding the exact binary value half-even.

    `format_string` rounds the printed decimal instead, which differs on close calls. Scaling by
    2**63 is exact, so quotient and remainder in DECIMAL decide the rounding exactly.
    """
    unit, one, half = 10**digits, F.lit(str(2**63)).cast("decimal(20,0)"), 2**62
    exact = (F.abs(x) * F.lit(float(2**63))).cast("bigint").cast("decimal(20,0)") * F.lit(unit)
    floor = F.call_function("div", exact, one)
    rest = exact % one
    up = (rest > half) | ((rest == half) & (floor % 2 == 1))
    k = F.when(F.abs(x) >= 1.0, F.lit(unit)).otherwise(floor + up.cast("int"))
    return F.concat(
        F.when(x < 0, "-").otherwise(""),
        F.call_function("div", k, F.lit(unit)).cast("string"),
        F.lit("."),
        F.lpad((k % unit).cast("string"), digits, "0"),
    )


def sentiment_label(compound: Column) -> Column:
    return (
        F.when(compound >= 0.05, "Positive").when(compound <= -0.05, "Negative").otherwise("Neutral")
    )


def scored(value: Column, digits: int, label: Column) -> Column:
    """Report cell such as `0.123 (Positive)`."""
    return F.concat(fixed_point(value, digits), F.lit(" ("), label, F.lit(")"))
