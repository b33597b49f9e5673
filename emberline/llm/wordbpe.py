"""The tokenizer library, applied to each distinct run of non-space characters once.

In the tokenizer file that is used here no rule looks across white space: special tokens hold none, the
normaliser works on one character or one composed sequence at a time, and the pre-tokenizer removes white
space. So the ids of a text are the ids of its ASCII-white-space-separated chunks, one after the other.
``ChunkEncoder.checked`` tests for that form of file; any other file is encoded text by text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Fixed values of the tokenizer file: the pre-tokenizer's pattern that PRE below restates for PLAIN chunks.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks of these characters only (printable ASCII but <, Latin-1 letters) are unchanged by NFC, their lower case is one character each, and they hold no special token.
PLAIN = re.compile("[!-;=-~À-ÖØ-öø-ÿ]*")
PRE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")


def byte_alphabet() -> dict[int, str]:
    """Byte to character, as byte-level models write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkEncoder(dict):
    """Chunk to its ids as little-endian bytes; a missing chunk is encoded by the library when it is asked for."""

    def __init__(self, path: str, held: int = 250_000) -> None:
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model, self.held, self.pieces = self.library.model, held, {}
        file = json.loads(self.library.to_str())
        self.size = max(self.library.get_vocab(with_added_tokens=True).values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.packed = [i.to_bytes(self.kind.itemsize, "little") for i in range(self.size)]
        alphabet = byte_alphabet()
        self.table = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(33, 256)}
        self.by_chunk = self.checked(file)

    @staticmethod
    def checked(file: dict) -> bool:
        """Whether the file has the form for which chunks can stand for the text."""
        steps = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        parts = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
        return steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": SPLIT} and parts[0]["behavior"] == "Removed" and not any(not t["content"].startswith("<") or re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in file["added_tokens"])

    def chunks(self, text: str) -> list[str]:
        """What can be encoded on its own: cut at ASCII white space only."""
        return re.findall(r"[^ \t-\r]+", text) if _ODD.search(text) else text.split()

    def piece(self, piece: str) -> bytes:
        """The model's ids of one pre-token of PLAIN characters in lower case."""
        if len(self.pieces) >= self.held:
            self.pieces.clear()
        got = self.pieces[piece] = b"".join([self.packed[t.id] for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.table))])
        return got

    def value(self, chunk: str) -> bytes:
        """The library's ids of one chunk."""
        if self.by_chunk and chunk.isascii() and chunk.isalpha():
            low = chunk.lower()
            return self.pieces.get(low) or self.piece(low)
        if not self.by_chunk or not PLAIN.fullmatch(chunk):
            return b"".join([self.packed[i] for i in self.library.encode(chunk, add_special_tokens=False).ids])
        held = self.pieces
        return b"".join([held.get(p) or self.piece(p) for p in PRE.findall(chunk.lower())])

    def __missing__(self, chunk: str):
        if len(self) >= self.held:
            self.clear()
        got = self.value(chunk)
        if len(chunk) < 200:  # what is held stays small
            self[chunk] = got
        return got

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if not self.by_chunk:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)
        return np.frombuffer(b"".join(map(self.__getitem__, self.chunks(text))), self.kind)


#: Python's split() takes these for white space too; only the ASCII white space set is cut at.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@lru_cache(maxsize=4)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One per Python worker."""
    return ChunkEncoder(path)
