"""Token counts of a unigram tokenizer without tokens: count-only Viterbi.

An Aho-Corasick automaton enumerates all vocabulary pieces in a text. For each place, dynamic
programming carries the best score of a segmentation that ends there and its number of pieces. Ties
follow the tokenizers library's unigram model: scores are added from left to right in double precision;
of equal ones the piece that starts first, the longest, stands. A character that is no piece itself may
be unknown, at ten less than the least score; with byte pieces in the vocabulary it counts as its bytes,
else neighbouring unknown characters count as one piece.

The library's Metaspace preparation is followed: spaces become U+2581, one is put before the text unless
it has one, and each starts a stretch that is segmented on its own and remembered. Empty and null texts
have no pieces. Extra columns are ignored, repeated rows treated one by one, no rows give no rows.

Pieces and scores are read from a public SentencePiece file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterscope.llm.shared import text_of

MARK = "\N{LOWER ONE EIGHTH BLOCK}"
#: How much less than the least score an unknown character has.
PENALTY = 10.0
#: Remembered stretches in a worker; a full memory is emptied, which costs time only.
REMEMBERED = 600_000

SCHEMA = "doc_id long, n_tokens long, score double"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece file, by id."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of texts."""

    def __init__(self, pieces: Iterable[tuple[str, float]], remembered: int = REMEMBERED):
        pieces = list(pieces)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - PENALTY
        known = {piece for piece, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))
        self.remembered = remembered
        self.memory: dict[str, tuple[int, float]] = {}

    def segmented(self, text: str) -> tuple[int, float]:
        """(number of pieces, score) of the best segmentation of one stretch."""
        n = len(text)
        best, count, open_ = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        unknown, as_bytes = self.unknown, self.bytes
        matches = self.automaton.iter(text)
        end, piece = next(matches, (n, None))
        for at in range(n):
            top = None
            single = False
            # Pieces that end here come longest first: the earliest start wins a tie.
            while end == at:
                size, score = piece
                start = at + 1 - size
                score += best[start]
                if top is None or score > top:
                    top, pieces = score, count[start] + 1
                single = single or size == 1
                end, piece = next(matches, (n, None))
            lost = False
            if not single:
                score = unknown + best[at]
                if top is None or score > top:
                    top, lost = score, True
                    pieces = count[at] + (len(text[at].encode("utf-8")) if as_bytes else 0 if open_[at] else 1)
            best[at + 1], count[at + 1], open_[at + 1] = top, pieces, lost
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        """(number of pieces, sum of the stretches' scores) of a whole text."""
        if not text:
            return 0, 0.0
        text = text.replace(" ", MARK)
        if text[0] != MARK:
            text = MARK + text
        pieces, total = 0, 0.0
        first, *rest = text.split(MARK)
        for stretch in rest:
            known = self.memory.get(stretch)
            if known is None:
                known = self.segmented(MARK + stretch)
                if len(self.memory) >= self.remembered:
                    self.memory.clear()
                self.memory[stretch] = known
            pieces += known[0]
            total += known[1]
        return pieces, total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each vocabulary in a Python worker, kept between its tasks."""
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and score of every row. `path`: the SentencePiece file, on all executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            found = [own.count(t) for t in text_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "n_tokens", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, SCHEMA)
