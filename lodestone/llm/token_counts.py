"""Token counts by Viterbi over a piece vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches at every end position; dynamic programming carries the best
path and the number of its pieces, never the pieces. Which path is best is the tokenizer's own rule:

* Unigram models: the best score wins; of paths of equal score into a position the one whose last piece starts first. A
  character that no single-character piece covers may be unknown, at the lowest score less 10.
* BPE models: the last piece of a position is the one that the model's merges leave there. Merges of a text are those of
  its parts up to any border that they leave, so a piece may follow another exactly if the two, joined and merged anew,
  stay these two; one piece at each position passes. The count is that of the model's own encoder.

An unknown character counts as its UTF-8 bytes where the vocabulary has byte pieces, else as one piece with the unknown
characters next to it. Text is otherwise as the model's normalizer gives it: a space before the first character, spaces
as U+2581.

No piece joins a character with a space after it, or a line end with anything (checked on loading; a vocabulary that
does is run over whole texts), so the best path is made up of the best paths of the units in between: a unit is counted
once and remembered. Scores are sums in double precision.

The vocabulary file is read on the driver only; about 1 MB of pieces and scores, bounded by the file, is broadcast.
Defined cases: a null or empty text has 0 tokens; repeated rows are counted each; whole texts are counted at any length;
an empty table gives an empty result; other columns, of whatever names, are never read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import python_ready

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
UNITS = re.compile(r"\n| *[^ \n]+| +")
#: Units longer than this aren't remembered; a worker remembers so many at most.
MEMO_CHARS, MEMO = 48, 500_000


def default_vocabulary() -> str:
    """Path of the public sentencepiece model of this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message; the value is an int or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        size = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        if size is None:
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


def is_bpe(model: bytes) -> bool:
    """True if a serialized sentencepiece model says that its type (field 3 of its trainer's settings) is BPE."""
    settings = next((v for k, v in _fields(model) if k == 2), b"")
    return dict(_fields(settings)).get(3, 1) == 2


class Unigram:
    """Pieces with scores, and whether unknown characters fall back to bytes."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        self.pieces, self.byte_fallback = pieces, byte_fallback
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.by_units = not any("\n" in p and p != "\n" or re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces)
        self.singles = frozenset(p for p, _ in pieces if len(p) == 1)
        self._automaton = None
        self._memo: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None, "_memo": {}}

    @classmethod
    def load(cls, path: str) -> Unigram:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(m.vocab_size())
        plain = [i for i in every if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i))]
        kind = Bpe if is_bpe(m.serialized_model_proto()) else Unigram
        return kind([(m.id_to_piece(i), float(m.get_score(i))) for i in plain], any(m.is_byte(i) for i in every))

    def _built(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for piece, score in self.pieces:
                a.add_word(piece, (len(piece), score))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def viterbi(self, text: str) -> int:
        """Pieces on the best path of a normalized text."""
        n = len(text)
        if self.singles.issuperset(text):  # no character can be unknown
            top, pieces = [0.0] + [float("-inf")] * n, [0] * (n + 1)
            for end, (length, score) in self._built().iter(text):  # the longest match at an end comes first
                start = end + 1 - length
                got = top[start] + score
                if got > top[end + 1]:
                    top[end + 1], pieces[end + 1] = got, pieces[start] + 1
            return pieces[n]
        best, count = [0.0] + [0.0] * n, [0] * (n + 1)
        unknown_end = [False] * (n + 1)  # the best path into this position ends with an unknown character
        ends: dict[int, list[tuple[int, float]]] = {}
        if self.pieces:
            for end, match in self._built().iter(text):
                ends.setdefault(end + 1, []).append(match)
        for e in range(1, n + 1):
            found, single = None, False
            for length, score in sorted(ends.get(e, ()), reverse=True):
                got = best[e - length] + score
                single = single or length == 1
                if found is None or got > found:
                    found, best[e], count[e] = got, got, count[e - length] + 1
            if not single:
                got = best[e - 1] + self.unknown
                if found is None or got > found:
                    best[e], unknown_end[e] = got, True
                    if self.byte_fallback:
                        more = len(text[e - 1].encode("utf-8", "surrogatepass"))
                    else:
                        more = 0 if unknown_end[e - 1] else 1
                    count[e] = count[e - 1] + more
        return count[n]

    def count(self, text: str | None) -> int:
        """Tokens of a raw text."""
        if not text:
            return 0
        text = " " + text
        if not self.by_units or not self.byte_fallback:
            return self.viterbi(text.replace(" ", SPACE))
        memo = self._memo
        units = UNITS.findall(text)
        counts = list(map(memo.get, units))
        if None in counts:
            for i, u in enumerate(units):
                if counts[i] is None:
                    k = counts[i] = memo.get(u) or self.viterbi(u.replace(" ", SPACE))
                    if len(u) <= MEMO_CHARS:
                        if len(memo) >= MEMO:
                            memo.clear()
                        memo[u] = k
        return sum(counts)


class Bpe(Unigram):
    """Pieces with scores that rank merges: of neighbours whose union is a piece, the best is merged first, the leftmost of equals."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        super().__init__(pieces, byte_fallback)
        self.rank = dict(pieces)
        self._follows: dict[tuple[str, str], bool] = {}

    def __getstate__(self):
        return super().__getstate__() | {"_follows": {}}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves of a short text."""
        parts = list(text)
        while len(parts) > 1:
            best, at = max(((self.rank.get(a + b, -math.inf), -k) for k, (a, b) in enumerate(pairwise(parts))), default=(-math.inf, 0))
            if best == -math.inf:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def may_follow(self, before: str, piece: str) -> bool:
        key = (before, piece)
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) >= MEMO:
                self._follows.clear()
            known = self._follows[key] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return known

    def viterbi(self, text: str) -> int:
        """Pieces of a normalized text: at each position the one piece that may end there, after the piece before it."""
        n = len(text)
        count, last = [0] * (n + 1), [""] * (n + 1)
        if self.singles.issuperset(text):  # every position has a match, and no piece is unknown
            follows = self._follows
            for end, (length, _) in self._built().iter(text):
                e = end + 1
                if not last[e]:
                    piece, before = text[e - length : e], last[e - length]
                    fits = follows.get((before, piece))
                    if self.may_follow(before, piece) if fits is None else fits:
                        last[e], count[e] = piece, count[e - length] + 1
            return count[n]
        ends: dict[int, list[int]] = {}
        if self.pieces:
            for end, (length, _) in self._built().iter(text):
                ends.setdefault(end + 1, []).append(length)
        for e in range(1, n + 1):
            for length in (*ends.get(e, ()), *(() if text[e - 1] in self.singles else (1,))):
                piece = text[e - length : e]
                if self.may_follow(last[e - length], piece):
                    last[e] = piece
                    count[e] = count[e - length] + (1 if piece in self.rank else self._unknown(last[e - length], piece))
                    break
            else:
                raise ValueError("no piece ends at a position: the merges of a prefix are not those of the text")
        return count[n]

    def _unknown(self, before: str, piece: str) -> int:
        if self.byte_fallback:
            return len(piece.encode("utf-8", "surrogatepass"))
        return 0 if before and before not in self.rank else 1


def n_tokens(model: Unigram, text: Column, spark) -> Column:
    """Token counts of a text column."""
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for batch in batches:
            yield pd.Series(np.array([m.count(t) for t in batch], dtype=np.int64))

    return of(text)


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every row of ``docs(doc_id, text)``."""
    model = Unigram.load(vocabulary or default_vocabulary())
    return docs.select("doc_id", n_tokens(model, F.col("text"), docs.sparkSession).alias("n_tokens"))
