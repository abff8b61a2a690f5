"""Byte-pair encoding and decoding with a public vocabulary file.

A word is a doubly linked list of symbols. A priority queue holds the adjacent pairs that have a merge
rank; the lowest rank, leftmost first, is merged, its neighbours are relinked and their new pairs are
queued. An entry whose symbols have changed since it was queued is stale and skipped. Decoding joins
the vocabulary strings of the ids.

Text is prepared as the file says: special tokens are cut out of the raw text, what lies between them
is composed (NFC), white space separates, letters are lowered one by one. Matches of the word pattern
never contain white space, so each run of other characters is encoded on its own and remembered.

Empty and null texts have no ids. Extra columns are ignored; repeated rows each give a row.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.normalizers import Lowercase
from tokenizers.pre_tokenizers import Split

from chatterscope.llm.shared import text_of

#: Unicode White_Space, which `\s` means in the vocabulary files' patterns.
WHITE = "\t\n\v\f\r \x85\xa0                　"
#: What str.split() also takes for white space.
_NOT_WHITE = re.compile("[\x1c-\x1f]")
#: Lower case that Python does not know starts at U+1C89.
_LATE = re.compile("[\u1c89-\U0010ffff]")
#: Remembered runs and words in a worker; a full memory is emptied, which costs time only.
REMEMBERED = 300_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """Byte-level vocabularies spell printable Latin-1 bytes as themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _newer() -> tuple[str, str, dict[int, str]]:
    """Letters and digits that are newer than the library's Unicode, and lower case newer than Python's.

    The three Unicode tables differ in the few characters that Python's does not know yet.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    not_yet = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    odd = []
    for name in ("L", "N"):
        known = Split(Regex(rf"\p{{{name}}}"), "removed", invert=True)
        mine = regex.compile(rf"\p{{{name}}}")
        odd.append("".join(c for c in not_yet if mine.match(c) and not known.pre_tokenize_str(c)))
    lower = Lowercase()
    raised = [c for c in not_yet if regex.match(r"\p{Changes_When_Lowercased}", c)]
    raised += regex.findall(r"[\p{L}&&\p{Changes_When_Lowercased}]", every, flags=regex.V1)
    return odd[0], odd[1], {ord(c): x for c in raised if (x := lower.normalize_str(c)) != c.lower()}


class Merges:
    """Merge ranks and vocabulary of one file. Symbols are ids; a pair of them is one integer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}
        self.ranks = {ids[x] << 32 | ids[y]: rank for rank, (x, y) in enumerate(model["merges"])}
        self.merged = [ids[x + y] for x, y in model["merges"]]
        self.inner = [ids[s] for s in byte_symbols()]
        self.last = [ids[s + suffix] for s in byte_symbols()]
        pattern = _word_pattern(spec["pre_tokenizer"])
        self.pattern = regex.compile(pattern)
        letters, digits, self.lower = _newer()
        self.odd = frozenset(letters + digits)
        for name, odd in (("L", letters), ("N", digits)):
            pattern = pattern.replace(rf"\p{{{name}}}", rf"[\p{{{name}}}--[{odd}]]")
        self.odd_pattern = regex.compile(pattern, regex.V1)

    def words(self, run: str) -> list[str]:
        """Matches of the word pattern."""
        if not run.isascii() and not self.odd.isdisjoint(run):
            return self.odd_pattern.findall(run)
        return self.pattern.findall(run)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one match of the word pattern."""
        raw = word.encode("utf-8")
        n = len(raw)
        inner, ranks, merged = self.inner, self.ranks, self.merged
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        # An entry is rank and place in one integer: the lowest rank first, then the leftmost.
        queue = []
        for i in range(n - 1):
            rank = ranks.get(symbols[i] << 32 | symbols[i + 1])
            if rank is not None:
                queue.append(rank << 32 | i)
        if not queue:
            return symbols
        heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or symbols[i] < 0 or ranks.get(symbols[i] << 32 | symbols[j]) != rank:
                continue  # stale: a symbol has gone or changed since
            symbol = symbols[i] = merged[rank]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(symbol << 32 | symbols[k])
                if rank is not None:
                    heappush(queue, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = ranks.get(symbols[h] << 32 | symbol)
                if rank is not None:
                    heappush(queue, rank << 32 | h)
        return [s for s in symbols if s >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        """Vocabulary strings, joined by a space as the library does for a file without a decoder."""
        return " ".join(self.strings[i] for i in ids)


def _word_pattern(pre: dict) -> str:
    split = next(p for p in pre["pretokenizers"] if p["type"] == "Split")
    if not split["invert"] or split["behavior"] != "Removed":
        raise ValueError("the file's word pattern must name what to keep")
    return split["pattern"]["Regex"]


class Encoder:
    """Encodes whole texts, remembering runs of characters without white space.

    A remembered run is (ids as decimal text, number of ids, vocabulary strings as text).
    """

    def __init__(self, merges: Merges, remembered: int = REMEMBERED):
        self.merges = merges
        self.remembered = remembered
        self.runs: dict[str, tuple[str, int, str]] = {}
        self.words: dict[str, list[int]] = {}
        self.special = re.compile("(" + "|".join(map(re.escape, merges.special)) + ")")
        self.white = re.compile(f"[{re.escape(WHITE)}]+")

    def _run(self, run: str) -> tuple[str, int, str]:
        ids: list[int] = []
        for word in self.merges.words(run):
            known = self.words.get(word)
            if known is None:
                known = self.merges.encode_word(word)
                if len(self.words) >= self.remembered:
                    self.words.clear()
                self.words[word] = known
            ids += known
        return " ".join(map(str, ids)), len(ids), self.merges.decode(ids)

    def _prepared(self, text: str) -> list[str]:
        if not text.isascii():
            # Lowered letter by letter: no final sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if _LATE.search(text):
                text = text.translate(self.merges.lower)
        text = text.lower()
        if _NOT_WHITE.search(text):
            return [x for x in self.white.split(text) if x]
        return text.split()

    def encode(self, text: str) -> list[tuple[str, int, str]]:
        """Runs of the text with at least one id, in order."""
        found = []
        for part in self.special.split(text) if "<|" in text else (text,):
            if part in self.merges.special:
                found.append((str(self.merges.special[part]), 1, part))
                continue
            for run in self._prepared(part):
                known = self.runs.get(run)
                if known is None:
                    known = self._run(run)
                    if len(self.runs) >= self.remembered:
                        self.runs.clear()
                    self.runs[run] = known
                if known[1]:
                    found.append(known)
        return found


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker, kept between its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(Merges(path))
    return _encoders[path]


def ids_of(text: str, path: str) -> list[int]:
    return [int(i) for run in encoder(path).encode(text) for i in run[0].split()]


def _sha256(parts: list[str]) -> str:
    return hashlib.sha256(" ".join(parts).encode("utf-8")).hexdigest()


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row: number of ids, and digests of the ids and of the text that they decode to.

    `path` names the vocabulary file; every executor must have it there.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in text_of(batch, "text"):
                runs = enc.encode(text)
                counts.append(sum(r[1] for r in runs))
                ids.append(_sha256([r[0] for r in runs]))
                decoded.append(_sha256([r[2] for r in runs]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digests, SCHEMA)
