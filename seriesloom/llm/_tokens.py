"""Token ids of whole texts by a public tokenizer of the `tokenizers` library, with each distinct chunk encoded once.

The tokenizer's rules never join characters across white space, so a text's ids are its
chunks' ids in order. A chunk of Latin letters, with or without marks of ASCII punctuation after
them, is the letters' ids and the marks' ids: the letters go straight to the library's BPE model,
lower-cased and byte-mapped as the tokenizer's own steps would have it. Everything else passes the
whole tokenizer. Each Python worker keeps the ids of the first chunks that it meets in dictionaries
of bounded size; other chunks are encoded again whenever they occur.
"""

from __future__ import annotations

import json
import os
import struct
from functools import cache
from string import punctuation

MOST_HELD, LONGEST_HELD = 200_000, 32
SEPARATORS = "\x1c\x1d\x1e\x1f"  # white space for str.split, but not for the tokenizer
PLAIN_END, DOTTED_I = "ɐ", "İ"  # Latin letters below the first are whole and lower-case alone, but for the second


def byte_names() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary, keyed by the byte's Latin-1 character."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def pack(*ids: int) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Held(dict):
    """Ids by chunk; a chunk that is missing is encoded, and kept while there is room."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        self.lowers = "Lowercase" in json.dumps(steps["normalizer"]) and "ByteLevel" in json.dumps(steps["pre_tokenizer"])
        self.names = byte_names()
        self.letters: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> bytes:
        return pack(*self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(punctuation)
        if self.lowers and core.isalpha() and (core.isascii() or max(core) < PLAIN_END and DOTTED_I not in core):
            key = core.lower()
            ids = self.letters.get(key)
            if ids is None:
                name = key if key.isascii() else key.encode().decode("latin-1").translate(self.names)
                ids = pack(*[t.id for t in self.model.tokenize(name)])
                if len(self.letters) < MOST_HELD and len(key) <= LONGEST_HELD:
                    self.letters[key] = ids
            if len(core) < len(chunk):
                tail = chunk[len(core) :]
                end = self.marks.get(tail)
                if end is None:
                    end = self.whole(tail)
                    if len(self.marks) < 10_000 and len(tail) <= LONGEST_HELD:
                        self.marks[tail] = end
                ids += end
        else:
            ids = self.whole(chunk)
        if len(self) < MOST_HELD and len(chunk) <= LONGEST_HELD:
            self[chunk] = ids
        return ids


class Chunked:
    """Encodes texts to little-endian 32-bit ids; the same ids as the tokenizer gives for the whole text."""

    def __init__(self, path: str) -> None:
        self.held = Held(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.held.__getitem__
        return [self.held.whole(x) if any(c in x for c in SEPARATORS) else b"".join(map(get, x.split())) for x in texts]


@cache
def encoder(path: str) -> Chunked:
    """One encoder for each worker and vocabulary."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Chunked(path)


def id_count(path: str) -> int:
    """One more than the largest id of a vocabulary."""
    return 1 + max(encoder(path).held.tokenizer.get_vocab(with_added_tokens=True).values())
