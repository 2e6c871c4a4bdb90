"""Ids of a vocabulary with word ends (lower case, white space dropped), word by word with a memory.

White space parts words and has no ids, so the ids of a text are those of its words in a row. A word is cut by the
vocabulary's own pattern and merged by rank, which tiktoken's core does on bytes: the end of a word is the byte
0xFF, which no UTF-8 text holds, and the merges that take it up have the lowest ranks of all. Words with anything but
plain letters, digits and signs of ASCII and Latin go to the tokenizer itself, and so do texts with rare white space.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer, pre_tokenizers

#: Distinct words whose ids a worker remembers; more only means that some are worked out again.
MEMORY_WORDS = 1_200_000
END = "</w>"


def byte_ranks(vocabulary: dict[str, int], end_of_word: str | None = END) -> dict[bytes, int]:
    """The vocabulary's tokens as bytes with their ranks, an end of word as 0xFF."""
    alphabet = _byte_alphabet()
    out = {}
    for token, rank in vocabulary.items():
        ended = end_of_word is not None and token.endswith(end_of_word) and token != end_of_word
        body, end = (token.removesuffix(end_of_word), b"\xff") if ended else (token, b"")
        if all(c in alphabet for c in body):
            out[bytes(alphabet[c] for c in body) + end] = rank
    return out


def _byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself if visible, else the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    if set(out) != set(pre_tokenizers.ByteLevel.alphabet()):
        raise ValueError("another byte alphabet than expected")
    return out


class _Memory(dict):
    """The ids of words, worked out when first asked for."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        ids = self[word] = self.learn(word)
        return ids


class EndedWords:
    """Ids as little-endian unsigned integers of ``width`` bytes; ``path`` is a file that every machine has."""

    #: White space other than that of ASCII, and what Python alone takes for white space.
    _others = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (9, 10, 11, 12, 13, 32)]
    #: Words whose letters each are in composed form and lower-case by themselves.
    _simple = re.compile("[\x00-\x7f\xa1-\u012f\u0131-\u024f]*").fullmatch

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if self.size <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        pattern = next(p["pattern"]["Regex"] for p in settings["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.cut = regex.compile(pattern).findall
        core = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=byte_ranks(settings["model"]["vocab"]), special_tokens={})
        self.merge = core._core_bpe.encode_single_piece
        self.memory = _Memory(self._learn)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, word: str) -> bytes:
        if not self._simple(word):
            return self.encode([word])[0]
        low, merge = word.lower(), self.merge
        if low.isalpha():
            ids = merge(low.encode() + b"\xff")
        else:
            ids = [i for piece in self.cut(low) for i in merge(piece.encode() + b"\xff")]
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids = self.memory.__getitem__
        return [self.encode([t])[0] if any(c in t for c in self._others) else b"".join(map(ids, t.split())) for t in texts]


_encoders: dict[str, EndedWords] = {}


def encoder(path: str) -> EndedWords:
    """The encoder of a file, one for each worker."""
    if path not in _encoders:
        _encoders[path] = EndedWords(path)
    return _encoders[path]
