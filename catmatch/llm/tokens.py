"""Token ids of whole texts by a public word-level BPE vocabulary, with a bounded cache of chunks.

The tokenizer drops white space and never joins across it, so a text's ids are the ids of its
chunks between white space, one after another. A chunk's ids are looked up; on a miss, a chunk
of plain letters with ASCII punctuation behind it goes straight to the BPE model, any other to
the tokenizer itself.
"""
from __future__ import annotations

import unicodedata

import numpy as np

END_ID = 1
_TAIL = b".,!?;:*$%&#|"
_LATIN_END = "ɐ"  # letters below: lower-casing and normal forms need no context


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkIds(dict):
    """chunk (bytes without white space) → its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, entries: int = 1_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.entries = entries
        self.words: dict[str, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}

    def whole(self, chunk: bytes) -> bytes:
        ids = self.tokenizer.encode(chunk.decode("utf-8"), add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    def word(self, text: str) -> bytes:
        found = self.words.get(text)
        if found is None:
            mapped = text if text.isascii() else self.byte_level.pre_tokenize_str(text)[0][0]
            found = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            if len(self.words) >= self.entries:
                self.words.clear()
            self.words[text] = found
        return found

    def __missing__(self, chunk: bytes) -> bytes:
        core = chunk.rstrip(_TAIL)
        tail = chunk[len(core):]
        text = core.decode("utf-8")
        lower = text.lower()
        if text.isalpha() and lower.isalpha() and max(lower) < _LATIN_END and unicodedata.is_normalized("NFC", text):
            end = self.tails.get(tail)
            if end is None:
                end = self.tails[tail] = self.whole(tail)
            ids = self.word(lower) + end
        else:
            ids = self.whole(chunk)
        if len(self) >= self.entries:
            self.clear()
        if len(self.tails) >= self.entries:
            self.tails = {b"": b""}
        self[chunk] = ids
        return ids

    def text(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))
