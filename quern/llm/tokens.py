"""Encoding with the tokenizers library, a piece of a text at a time."""

from __future__ import annotations

import os
from array import array

import numpy as np
import regex

#: Pieces, and words of pieces, that a worker remembers since it last made room, and once more before that.
CACHE = 600_000
#: The longest piece that is remembered.
LONGEST = 64
#: The last of the letters on which all versions of Unicode agree and that Python and the library class alike.
LAST_LETTER = "ſ"
#: Between characters that are no white space, a blank starts a new word of a byte-level tokenizer whatever surrounds it.
CUT = regex.compile(r"(?<=\S) (?=\S)")
#: Marks that are a word of their own at the end of a piece of letters.
MARKS = (",", ".")
#: Characters that a regex engine may count as white space though str.isspace() doesn't.
SPACES = "᠎​﻿"
#: Fixed value: the published pattern of byte-level tokenizers.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Other pieces are given to the library whole.
PLAIN = regex.compile("[\t\n\r\x20-\x7eÀ-ſ]*+")


class LooseBlank(Exception):
    """A blank beside other white space."""


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable Latin-1 stands for itself, the rest follow 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Remembered(dict):
    """A dict that makes values by `make` and, when full, forgets what wasn't asked for since it was full before."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class ChunkEncoder:
    """Ids of a text as little-endian bytes, two or four to an id.

    A byte-level tokenizer splits texts into words before it merges, and a single blank between two characters that are
    no white space always begins a word. Texts are cut there; a piece that isn't remembered is split into words by the
    tokenizer's pattern, and a word that isn't remembered is merged by the library's own model. Pieces with characters
    beyond PLAIN or special tokens are given to the library. Tokenizers with another pre-tokenizer are given whole texts.
    """

    def __init__(self, path: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.dtype, self.code = f"<u{self.width}", {2: "H", 4: "I"}[self.width]
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        pre = self.library.pre_tokenizer
        self.cuts = pre is not None and "ByteLevel" in repr(pre) and "use_regex=True" in repr(pre) and "add_prefix_space=False" in repr(pre) and self.library.normalizer is None
        self.model, self.letters = self.library.model, dict(enumerate(byte_letters()))
        #: first letters of tokens that are found before words are split
        self.marks = {t.content[:1] for t in self.library.get_added_tokens_decoder().values()}
        self.words = Remembered(self._merge)
        self.pieces = Remembered(self._piece)

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _merge(self, word: str) -> bytes:
        written = word.replace(" ", "Ġ") if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(written)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece after a blank."""
        if piece.isalpha() and max(piece) <= LAST_LETTER:
            return self._merge(" " + piece)
        if piece[-1:] in MARKS and piece[-2:-1].isalpha() and piece[:-1].isalpha():
            return self.pieces[piece[:-1]] + self.words[piece[-1]]
        if not piece or piece[0].isspace() or piece[-1].isspace() or piece[0] in SPACES or piece[-1] in SPACES:
            raise LooseBlank
        return self._spaced(piece)

    def _spaced(self, piece: str) -> bytes:
        if PLAIN.fullmatch(piece) is None or any(m in piece for m in self.marks):
            return self._ids(" " + piece)
        return b"".join(map(self.words.__getitem__, WORD.findall(" " + piece)))

    def __call__(self, text: str) -> bytes:
        if not self.cuts:
            return self._ids(text)
        first, *later = text.split(" ")
        try:
            if later and (not first or first[-1].isspace() or first[-1] in SPACES):
                raise LooseBlank
            return self._ids(first) + b"".join(map(self.pieces.__getitem__, later))
        except LooseBlank:
            first, *later = CUT.split(text)
            return self._ids(first) + b"".join(map(self._spaced, later))


_encoders: dict[tuple[str, int | None], ChunkEncoder] = {}


def encoder_for(path: str, end_id: int | None = None) -> ChunkEncoder:
    """One encoder for each worker process, so that its cache outlives a task."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = ChunkEncoder(path, end_id)
    return _encoders[path, end_id]
