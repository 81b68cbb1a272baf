"""Token counts of a unigram vocabulary without its tokens: Viterbi over Aho-Corasick matches.

Only the best score and the number of pieces are carried along. Ties are decided as the tokenizer
decides them: of equally good ways to a position the one whose last piece begins earliest, unknown
characters last, and unknown characters in a row as one piece. Words repeat, so counts are cached.
"""

from __future__ import annotations

import math
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillroll.llm.rowwise import with_text_columns

UNKNOWN_PENALTY = 10.0  # fixed value: below the least score of the vocabulary
MARK = "▁"
CACHE_ENTRIES = 600_000
# white space of Unicode; the usual split also takes the separators \x1c to \x1f
WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")


def zipf_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with minus the logarithm of their place as score; no control or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    usual = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return [(model.id_to_piece(i), -math.log(place)) for place, i in enumerate(usual, start=1)]


class PieceCounter:
    """Counts the pieces of texts that are split at white space, each word marked at its beginning."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.matches = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and piece not in self.matches:
                self.matches.add_word(piece, (len(piece), score))
        if vocabulary:
            self.matches.make_automaton()
        self.empty = not len(self.matches)
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def pieces(self, sequence: str) -> int:
        """Number of pieces on the best way through `sequence`."""
        n = len(sequence)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        single = bytearray(n)
        for end, (length, score) in self.matches.iter(sequence) if not self.empty else ():
            ending[end].append((length, score))
            if length == 1:
                single[end] = 1
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), bytearray(n + 1)
        for end in range(1, n + 1):
            best = None
            # the longest match begins earliest; a later one wins only if it is strictly better
            for length, s in sorted(ending[end - 1], key=lambda m: -m[0]):
                s += score[end - length]
                if best is None or s > best:
                    best, count[end] = s, count[end - length] + 1
            if not single[end - 1]:
                s = self.unknown + score[end - 1]
                if best is None or s > best:
                    best, unknown[end] = s, 1
                    count[end] = count[end - 1] + (0 if unknown[end - 1] else 1)
            score[end] = best
        return count[n]

    def _word(self, word: str) -> int:
        """Pieces of a word; a mark in the text itself begins a new sequence, and none is set before it."""
        parts = word.split(MARK)
        return sum(self.pieces(MARK + part) for i, part in enumerate(parts) if i or part)

    def count(self, text: str) -> tuple[int, int]:
        """(pieces, words) of a text."""
        words = text.split()
        if any("\x1c" <= c <= "\x1f" for c in set(text)):
            words = [w for w in WHITE.split(text) if w]
        cache, total = self.cache, 0
        for word in words:
            n = cache.get(word)
            if n is None:
                if len(cache) >= CACHE_ENTRIES:
                    cache.clear()
                n = cache[word] = self._word(word)
            total += n
        return total, len(words)


_counters: dict[str, PieceCounter] = {}


def count_tokens(
    docs: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns `keep`, n_tokens and n_words, one row per row of `docs`. Null and empty texts have none."""

    def run(data, offsets):
        if model_path not in _counters:
            _counters[model_path] = PieceCounter(zipf_vocabulary(model_path))
        counter = _counters[model_path]
        raw, at = data.tobytes(), offsets.tolist()
        got = [counter.count(raw[a:b].decode()) for a, b in zip(at, at[1:])]
        return [[g[0] for g in got], [g[1] for g in got]]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("n_words", T.LongType())]
    return with_text_columns(docs, run, fields, text_col, keep)
