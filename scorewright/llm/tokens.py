"""Byte-level BPE encoding with a bounded memo of words.

The vocabulary's pre-tokeniser always starts a new piece in front of a single
space or line end that stands between non-spaces, and between a letter and a
closing mark.  A text without two adjacent white-space characters is therefore
encoded word by word (with the leading space) and the results joined.  Words
repeat, so most come from the memo; the ``tokenizers`` library encodes the
others.  Texts with adjacent spaces go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Words kept in each of the memo's two generations (about 200 bytes each).
MEMO = 350_000
_LINE = "\x02"  # stands for a line end in front of a word
_MARKED = re.compile("(" + _LINE + r"?[a-zA-ZÀ-ÖØ-öø-ɏ]+)([^\w\s']+)").fullmatch  # a word, then marks: a border between
_LONE = re.compile(r"[.,](?<![^\W_].)[ \n]").search  # a mark that may join what stands before it; marks are found first
_CONTROL = ("\x02", "\x03", "\x04")
_plain = re.compile(r"[a-zA-ZÀ-ÖØ-öø-ɏ]+").fullmatch


def byte_alphabet() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """word -> ids of " word" as bytes; the older generation is dropped when the younger is full."""

    def __init__(self, library, dtype: np.dtype):
        super().__init__()
        self.library, self.dtype, self.old, self.bare = library, dtype, {}, {}
        self.alphabet = byte_alphabet()
        self.line = self.whole("\n")
        self["\x03"], self["\x04"] = self.whole(","), self.whole(".")
        self.space, self.code = self.alphabet[0x20], "H" if dtype.itemsize == 2 else "I"

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def word(self, word: str, before: str) -> bytes:
        """Letters only: a single piece, so the model alone decides."""
        piece = before + (word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet))
        return array(self.code, [t.id for t in self.library.model.tokenize(piece)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            marked = _MARKED(chunk)
            if marked:
                marks = marked[2]
                if marks not in self.bare and len(self.bare) < MEMO:
                    self.bare[marks] = self.whole(marks)
                return self[marked[1]] + (self.bare.get(marks) or self.whole(marks))
            if _plain(chunk):
                got = self.word(chunk, self.space)
            elif chunk[:1] == _LINE:
                got = self.line + self.word(chunk[1:], "") if _plain(chunk[1:]) else self.whole("\n" + chunk[1:])
            else:
                got = self.whole(" " + chunk)
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
            self["\x03"], self["\x04"] = self.old["\x03"], self.old["\x04"]
        self[chunk] = got
        return got


class ChunkEncoder:
    """ids of whole texts as little-endian bytes, ``dtype`` wide per id."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.memo = _Memo(self.library, self.dtype)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        flat = text.replace("\n", " " + _LINE)
        if "  " in flat or " " + _LINE + " " in flat or any(map(text.__contains__, _CONTROL)):
            return self.memo.whole(text)
        if not _LONE(text):
            flat = flat.replace(", ", " \x03 ").replace(". ", " \x04 ")
        head, *rest = flat.split(" ")
        start = self.memo.whole(head) if head else b""  # no space stands before it
        return start + b"".join(map(self.memo.__getitem__, rest))


_LOADED: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
