"""Byte-level BPE through the tokenizers library, with its results kept for each word.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, and a word's ids
come from the library's model once; so ids equal those of encoding the whole text. What a
worker has learnt serves its later tasks, and goes when none has come for a while.
"""

from __future__ import annotations

import os
import threading
from collections.abc import Iterator
from contextlib import contextmanager

import regex

from keyloom.llm.workers import give_back

#: fixed values: the pre-tokenizer pattern and the printable stand-ins for bytes of byte-level BPE
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
STAND_IN = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in PRINTABLE)}

#: where one of these occurs, the pattern itself cuts the text: runs of white space belong together
UNSAFE = ("  ", "\n\n", " \n", "\n ", "\0", *"\t\v\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))


class _Pieces(dict):
    """Ids (little-endian unsigned 32 bits) of one pre-token."""

    def __init__(self, model) -> None:
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        stand_in = piece.encode().decode("latin-1").translate(STAND_IN)
        self[piece] = out = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(stand_in)])
        return out


class _Words(dict):
    """Ids of a chunk between two safe cuts, from its pre-tokens."""

    def __init__(self, pieces: _Pieces) -> None:
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        self[word] = out = b"".join(map(self.pieces.__getitem__, PATTERN.findall(word)))
        return out


class Encoder:
    """encode(text) gives ids as bytes. `keep` bounds both memories; a full one is emptied."""

    def __init__(self, path: str, keep: int = 1_200_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keep = keep
        self.pieces = _Pieces(self.model)
        self.words = _Words(self.pieces)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        for memory in (self.pieces, self.words):
            if len(memory) > self.keep:
                memory.clear()
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in UNSAFE):
            return b"".join(map(self.pieces.__getitem__, PATTERN.findall(text)))
        return b"".join(map(self.words.__getitem__, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))

    def forget(self) -> None:
        self.pieces.clear()
        self.words.clear()


_encoders: dict[str, Encoder] = {}
_forgetting: threading.Timer | None = None

IDLE_SECONDS = 2.0  # between two tasks of a stage less time passes


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, so that what it has learnt serves later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Drop what this worker's encoders have learnt: some hundred MB, which the executor's later stages need."""
    for each in _encoders.values():
        each.forget()
    give_back()


@contextmanager
def lent(path: str) -> Iterator[Encoder]:
    """The worker's encoder for one task. If no other task asks for it within IDLE_SECONDS, it forgets; in the middle of a task that would cost time only."""
    global _forgetting
    if _forgetting is not None:
        _forgetting.cancel()
    try:
        yield encoder(path)
    finally:
        _forgetting = threading.Timer(IDLE_SECONDS, forget)
        _forgetting.daemon = True
        _forgetting.start()


def resolve(name_or_path: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public tokenizers."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)
