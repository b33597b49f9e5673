"""Operator 5: token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton over the vocabulary lists, at every end position, all pieces that end there, the
longest first. Dynamic programming keeps for each position the best score and that path's number of tokens.
The tokenizer's tie rules are kept exactly: a path replaces another only if its score is strictly higher, so
of equal scores the one whose last piece begins first wins; a character that is no piece itself is an unknown
piece of score (least score - 10), tried after all pieces that begin there; unknown characters count as their
UTF-8 bytes where the vocabulary has byte pieces, else a run of them counts as one. Spaces are characters like
any other: a run of them is split as the scores say, and only places that no piece reaches over part a text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import map_rows, text_of

#: The tokenizer's penalty for an unknown character, and its sign for a space.
UNKNOWN = 10.0
SPACE = "▁"
#: Stretches of more characters are counted with the places still needed only.
SHORT = 10_000
_STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def sentencepiece_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """The pieces that text can match, with their scores, and whether there is a piece for every byte.

    Control, unknown, unused and byte pieces never match text: their names in a text are ordinary characters.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    silent = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids if not silent(i)], sum(map(model.is_byte, ids)) == 256


class CountingViterbi(dict):
    """Stretch of text (with its space signs) to its number of tokens."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, held: int = 300_000) -> None:
        super().__init__()
        self.held, self.bytes = held, byte_fallback
        pieces: dict[str, float] = {p: s for p, s in vocabulary if p}
        self.unknown = min(pieces.values()) - UNKNOWN
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.longest = max(map(len, pieces))
        # A text falls into stretches before its runs of space signs if no piece reaches over such a place and the
        # scores are whole numbers, whose sums are exact in any order.
        crossing = any(b == SPACE != a for p in pieces for a, b in zip(p, p[1:]))
        self.cuts = not crossing and SPACE in self.single and all(float(s).is_integer() for s in pieces.values())

    def count(self, text: str) -> int:
        """Tokens of one stretch of text, in time in proportion to its length."""
        n = len(text)
        if not n:
            return 0
        low = float("-inf")
        if n < SHORT and self.single.issuperset(text):  # no character is unknown
            best, count = [0.0] + [low] * n, [0] * (n + 1)
            for last, (length, score) in self.automaton.iter(text):
                at = last + 1 - length
                if (score := score + best[at]) > best[last + 1]:
                    best[last + 1], count[last + 1] = score, count[at] + 1
            return count[n]
        # only so many places back are ever read as the longest piece has characters
        size = 1 << self.longest.bit_length()
        mask = size - 1
        best, count, run = [low] * size, [0] * size, [False] * size
        best[0] = 0.0
        done = 0  # places that all candidates have been tried for

        def settle(end: int) -> None:
            """The unknown piece of the character before ``end``, then room for the next place."""
            c, at, to = text[end - 1], (end - 1) & mask, end & mask
            if c not in self.single and best[at] + self.unknown > best[to]:
                best[to] = best[at] + self.unknown
                count[to] = count[at] + (len(c.encode()) if self.bytes else 0 if run[at] else 1)
                run[to] = True
            best[(end + 1) & mask], run[(end + 1) & mask] = low, False

        for last, (length, score) in self.automaton.iter(text):
            end = last + 1
            while done < end - 1:
                done += 1
                settle(done)
            at, to = (end - length) & mask, end & mask
            if best[at] + score > best[to]:
                best[to], count[to], run[to] = best[at] + score, count[at] + 1, False
        while done < n:
            done += 1
            settle(done)
        return count[n & mask]

    def __missing__(self, word: str) -> int:
        if len(self) >= self.held:
            self.clear()
        n = self.count(word)
        if len(word) < 200:
            self[word] = n
        return n

    def of_text(self, text: str) -> int:
        """Tokens of a whole text: a space sign stands before it and for every space."""
        if not text:
            return 0
        signed = SPACE + text.replace(" ", SPACE)
        return sum(map(self.__getitem__, _STRETCH.findall(signed))) if self.cuts else self.count(signed)


@lru_cache(maxsize=2)
def counter(path: str) -> CountingViterbi:
    """One per Python worker."""
    return CountingViterbi(*sentencepiece_vocabulary(path))


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """Every whole text's number of tokens, its code points and its tokens per code point.

    The vocabulary and the scores are those of the model file, used as a unigram model. Null and empty texts
    have no tokens (and ratio 0); repeated rows each get a row; other columns are ignored; an empty table
    gives an empty result. A long text without spaces is counted whole, in time in proportion to its length and
    with memory for the longest piece only.
    """
    rows = map_rows(docs.select(F.col(key).cast("long").alias(key), text_of().alias("text")), f"{key} long, n_chars long, n_tokens long", lambda r: {key: r[key], "n_chars": [len(t) for t in r["text"]], "n_tokens": [counter(model).of_text(t) for t in r["text"]]})
    return rows.withColumn("tokens_per_char", F.when(F.col("n_chars") > 0, F.col("n_tokens") / F.col("n_chars")).otherwise(F.lit(0.0)))
