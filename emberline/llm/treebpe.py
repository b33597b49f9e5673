"""Operator 9: BPE encoding and decoding, with tree concatenation for long unsplit text.

Text is cut at white space, where the tokenizer's rules never look across (see ``wordbpe``). A run without
white space is *unsplit*; one of more than ``long`` characters isn't given to the merge loop whole. Its
pre-tokens are halved again and again down to leaves, leaves are encoded independently - on the cluster, each
leaf of a huge run is a row of its own - and neighbours are put together in a tree: a window around the join
is encoded anew and grows until its first and last token are tokens of the left and the right side. Every two
adjacent tokens then stand side by side in some exact encoding, which makes the whole encoding exact.

Texts are taken many at a time: Arrow cuts them and numbers their different chunks, each of which is encoded once,
and puts ids and tokens of all chunks together again.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import map_rows, text_of
from emberline.llm.wordbpe import SPLIT, ChunkEncoder, byte_alphabet

#: A pre-token above this many symbols is encoded as a tree of leaves.
LEAF = 256
#: A run without white space above this many characters is dealt out over the cluster.
HUGE = 20_000
#: Texts of this many characters in all, or a single longer one, are taken together.
TOGETHER = 2_000_000


class TreeEncoder(ChunkEncoder):
    """Texts to (ids as text, decoded text, count); pre-tokens of more than ``leaf`` symbols by tree concatenation."""

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        super().__init__(path, held=60_000)
        self.leaf, self.alphabet, self.split = leaf, byte_alphabet(), regex.compile(SPLIT)
        name = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.names = pa.array([name.get(i) for i in range(self.size)], pa.large_string())
        self.digits = pa.array([str(i) for i in range(self.size)], pa.large_string())

    # -- what only long pre-tokens need --------------------------------------------------------------------
    @cached_property
    def file(self) -> dict:
        return json.loads(self.library.to_str())

    @cached_property
    def rank(self) -> dict[tuple[str, str], int]:
        return {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(self.file["model"]["merges"])}

    @cached_property
    def vocab(self) -> dict[str, int]:
        return self.file["model"]["vocab"]

    @cached_property
    def suffix(self) -> str:
        return self.file["model"]["end_of_word_suffix"] or ""

    @cached_property
    def special(self) -> list[str]:
        return [t["content"] for t in self.file["added_tokens"]]

    @cached_property
    def at_special(self):
        return regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    # -- the merge loop, for leaves and windows ------------------------------------------------------------
    def merge(self, symbols: list[str]) -> list[str]:
        """Exact merges by rank, left before right at equal rank."""
        n = len(symbols)
        symbols, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(self.rank[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] is None or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (p := (symbols[left], symbols[right])) in self.rank:
                    heapq.heappush(heap, (self.rank[p], left, p))
        return [s for s in symbols if s is not None]

    def symbols(self, tokens: list[str]) -> list[str]:
        """The single-byte symbols of tokens; the end of a word stays with the last byte."""
        out: list[str] = []
        for t in tokens:
            end = self.suffix and t.endswith(self.suffix) and len(t) > len(self.suffix)
            body = t[: -len(self.suffix)] if end else t
            out += [*body[:-1], body[-1] + (self.suffix if end else "")]
        return out

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """The encoding of the text of two neighbours, given their own encodings."""
        if not left or not right:
            return left or right
        k = 2
        while True:
            a, b = left[-k:], right[:k]
            window = self.merge(self.symbols(a + b))
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def tree(self, symbols: list[str]) -> list[str]:
        """The encoding of a long pre-token: halves, down to leaves, put together again."""
        if len(symbols) <= self.leaf:
            return self.merge(symbols)
        half = len(symbols) // 2
        return self.join(self.tree(symbols[:half]), self.tree(symbols[half:]))

    # -- chunks --------------------------------------------------------------------------------------------
    def parts(self, chunk: str) -> list[tuple[str, bool]]:
        """A chunk's pre-tokens as byte-level text, and its special tokens (marked true), as the library takes them apart."""
        out = []
        for x in self.at_special.split(chunk) if self.at_special else [chunk]:
            if x in self.special:
                out.append((x, True))
            elif x:
                low = self.library.normalizer.normalize_str(x)
                out += [("".join(self.alphabet[b] for b in p.encode()), False) for p in self.split.findall(low)]
        return out

    def word(self, piece: str) -> list[str]:
        return self.tree([*piece[:-1], piece[-1] + self.suffix])

    def value(self, chunk: str) -> bytes:
        if len(chunk) <= self.leaf or not self.by_chunk:
            return super().value(chunk)
        ids = [i for piece, special in self.parts(chunk) for i in ([self.library.token_to_id(piece)] if special else [self.vocab[t] for t in self.word(piece) if t in self.vocab])]
        return b"".join([self.packed[i] for i in ids])

    # -- texts ---------------------------------------------------------------------------------------------
    def texts(self, texts: list[str]) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """For each text its ids and its decoded text (tokens joined by one space: the file names no decoder), and the number of ids."""
        cut = pa.array(texts, pa.large_string())
        if self.by_chunk:  # at ASCII white space; an empty chunk beside leading or trailing white space has no ids
            cut = pc.ascii_split_whitespace(cut)
            ends, numbered = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        else:
            ends, numbered = np.arange(len(texts) + 1), cut.dictionary_encode()
        raw = [self.value(chunk) for chunk in numbered.dictionary.to_numpy(zero_copy_only=False)]
        counts = np.fromiter(map(len, raw), np.int64, len(raw)) // self.kind.itemsize
        ids, at = pa.array(np.frombuffer(b"".join(raw), self.kind)), numbered.indices.to_numpy()
        some = counts[at] > 0  # chunks without ids take no part
        at, ends = at[some], _ends(some)[ends]
        join = lambda ends, parts: pc.binary_join(pa.LargeListArray.from_arrays(ends, parts), pa.scalar(" ", pa.large_string()))
        both = [join(ends, join(_ends(counts), names.take(ids)).take(pa.array(at))) for names in (self.digits, self.names)]
        return (*both, np.diff(_ends(counts[at])[ends]))

    def both(self, text: str) -> tuple[str, str, int]:
        """The same of one text."""
        ids, decoded, count = self.texts([text])
        return ids[0].as_py(), decoded[0].as_py(), int(count[0])


def _ends(counts: np.ndarray) -> np.ndarray:
    """Where stretches of so many end, after a zero."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


@lru_cache(maxsize=1)
def tree_encoder(path: str) -> TreeEncoder:
    """One per Python worker, while a task is at work: a worker that goes on with other tasks doesn't keep it."""
    return TreeEncoder(path)


def _let_go() -> None:
    """What a worker does at a task's end: neither the encoder nor freed Arrow memory is kept for the next stage."""
    tree_encoder.cache_clear()
    pa.default_memory_pool().release_unused()


def _together(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of at most ``TOGETHER`` characters or of one text."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > TOGETHER:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _digest(rows: dict, path: str, ids: bool) -> dict:
    out: dict = rows | {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
    for texts in _together(rows["text"]):
        numbers, decoded, counts = tree_encoder(path).texts(texts)
        out["n_tokens"] += counts.tolist()
        for name, column in (("ids_sha256", numbers), ("decoded_sha256", decoded)):
            out[name] += [hashlib.sha256(x).hexdigest() for x in column.cast(pa.large_binary()).to_pylist()]
        if ids:
            out["ids"] += [list(map(int, x.split())) for x in numbers.to_pylist()]
            out["decoded"] += decoded.to_pylist()
    return out


#: Parts that are joined at a time, and levels of it: a run's parts come down by 64 * 64 before one task has them.
_FAN, _LEVELS = 64, 2
#: A run of this many characters without white space makes its text one whose leaves are dealt out as rows.
_RUN = r"[^ \t-\x0d]{%d,}"


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", outputs: bool = False, huge: int = HUGE) -> DataFrame:
    """Every whole text's number of ids and the digests of its ids and of its decoded text.

    With ``outputs`` the ids and the decoded text come too. Texts that hold a run of ``huge`` or more
    characters without white space have their leaves encoded as rows of their own, all over the cluster, and joined
    level by level; only the last joins, and the digests of the whole text, are one task's. The ids are the same
    either way.
    Null text counts as empty (no ids, digests of nothing); repeated rows each get their row; other columns
    are ignored; an empty table gives an empty result.
    """
    schema = f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if outputs else "")
    texts = docs.select(F.col(key).cast("long").alias(key), text_of().alias("text"))
    has_run = F.col("text").rlike(_RUN % huge)
    plain = map_rows(texts.where((F.length("text") < huge) | ~has_run), schema, lambda rows: _digest(rows, tokenizer, outputs), _let_go)
    return plain.unionByName(_huge(texts.where((F.length("text") >= huge) & has_run), key, schema, tokenizer, outputs))


def _huge(texts: DataFrame, key: str, schema: str, tokenizer: str, outputs: bool) -> DataFrame:
    """Texts with huge unsplit runs: their pre-tokens' leaves are encoded as rows, neighbours joined ``_FAN`` at a time, level by level, and what is left of a text put together."""
    leaf_rows = "row_id long, %s long, at long, part long, kind string, symbols array<string>" % key

    def leaves(batches):
        encoder = tree_encoder(tokenizer)
        for frame in batches:
            for row_id, doc, text in frame[["row_id", key, "text"]].itertuples(index=False):
                out, at = [(row_id, doc, -1, 0, "none", [])], 0  # the text itself, should it hold no token
                for chunk in encoder.chunks(text):
                    for piece, special in encoder.parts(chunk):
                        if special or len(piece) <= encoder.leaf:
                            out.append((row_id, doc, at, 0, "special" if special else "word", [piece]))
                        else:
                            symbols = [*piece[:-1], piece[-1] + encoder.suffix]
                            out += [(row_id, doc, at, i, "leaf", symbols[i : i + encoder.leaf]) for i in range(0, len(symbols), encoder.leaf)]
                        at += 1
                yield pd.DataFrame(out, columns=["row_id", key, "at", "part", "kind", "symbols"])

    def encoded(batches):
        encoder = tree_encoder(tokenizer)
        for frame in batches:
            frame["symbols"] = [list(s) if kind in ("special", "none") else encoder.merge(list(s)) if kind == "leaf" else encoder.word(s[0]) for kind, s in zip(frame["kind"], frame["symbols"])]
            yield frame

    def levelled(frames):
        """Rows sorted by text, pre-token and part: parts of one stretch become one."""
        encoder = tree_encoder(tokenizer)
        held: list = []

        def close():
            level = [list(r[-1]) for r in held]
            while len(level) > 1:  # neighbours, then neighbours of those
                level = [encoder.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            return (*held[0][:3], held[0][3] // _FAN, held[0][4], level[0])

        names = ["row_id", key, "at", "part", "kind", "symbols"]
        for frame in frames:
            out = []
            for r in frame[names].itertuples(index=False, name=None):
                if held and (r[0], r[2], r[3] // _FAN) != (held[0][0], held[0][2], held[0][3] // _FAN):
                    out.append(close())
                    held = []
                held.append(r)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([close()] if held else [], columns=names)

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        encoder, tokens = tree_encoder(tokenizer), []
        for (_, kind), group in frame.sort_values(["at", "part"]).groupby(["at", "kind"], sort=True):
            level = [list(s) for s in group["symbols"]]
            while len(level) > 1:  # neighbours, then neighbours of those
                level = [encoder.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            tokens += level[0]
        ids = [encoder.library.token_to_id(t) for t in tokens]
        ids, names = zip(*[(i, t) for i, t in zip(ids, tokens) if i is not None]) if ids else ((), ())
        a, b = " ".join(map(str, ids)), " ".join(names)
        row = {key: [frame[key].iloc[0]], "n_tokens": [len(ids)], "ids_sha256": [hashlib.sha256(a.encode()).hexdigest()], "decoded_sha256": [hashlib.sha256(b.encode()).hexdigest()]}
        return pd.DataFrame(row | ({"ids": [list(ids)], "decoded": [b]} if outputs else {}))

    rows = texts.withColumn("row_id", F.monotonically_increasing_id()).mapInPandas(leaves, leaf_rows)
    level = rows.repartition(F.col("row_id"), F.col("at"), F.col("part")).mapInPandas(encoded, leaf_rows)
    for _ in range(_LEVELS):
        stretch = F.floor(F.col("part") / _FAN)
        level = level.repartition(F.col("row_id"), F.col("at"), stretch).sortWithinPartitions("row_id", "at", "part").mapInPandas(levelled, leaf_rows)
    return level.groupBy("row_id").applyInPandas(joined, schema)
