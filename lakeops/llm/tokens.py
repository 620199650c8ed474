"""Token ids of texts, word by word: a worker encodes a word once while it remembers it.

Both splitters cut a text only where the tokenizer itself always begins a new piece, so the
ids of the parts in turn are those of the whole text.  The memory is bounded by two
generations of ``MOST`` words: a full young one becomes the old one, whose words move up
again when they are met, so frequent words stay.
"""

from __future__ import annotations

import os
import re
from array import array

#: Words in a generation of a worker's memory.
MOST = 600_000
#: A letter at the end, as the tokenizers see it (ASCII and Latin-1): what follows starts a new piece.
_LETTER = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])\Z")
#: A space where a piece may not begin: white space or nothing follows.
_ODD = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
#: Words of letters alone that no normalisation changes: the model sees them as one piece, byte by byte.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+\Z").match
_LETTERS = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+\Z").match
_BODY = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([\x00-@\[-`{-\x7f].*)\Z", re.S)
#: Signs and at most one line feed before a letter: the letter starts a new piece (a space or ' would join it).
_TAIL = re.compile(r"([!-&(-@\[-`{-~]*\n?)([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff].*)\Z", re.S)


class Ids(dict):
    """Ids as bytes of a word that ``encode`` turns into ids; ``cut`` splits words into a body and an end."""

    def __init__(self, encode, cut, code: str, most: int = MOST):
        super().__init__()
        self.encode, self.cut, self.code, self.most = encode, cut, code, most
        self.old, self.ends = {}, {}

    def __missing__(self, word):
        ids = self.old.get(word)
        if ids is None:
            body, end = self.cut(word)
            if end or body != word:
                ids = self[body] + self.end(end)
            else:
                ids = array(self.code, self.encode(word)).tobytes()
        self[word] = ids
        return ids

    def end(self, end) -> bytes:
        if end and end not in self.ends:
            if len(self.ends) > 10_000:
                self.ends.clear()
            self.ends[end] = array(self.code, self.encode(end, True)).tobytes()
        return self.ends[end] if end else b""

    def turn(self) -> None:
        """Forget the old generation once the young one is full."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def of(self, words) -> bytes:
        self.turn()
        return b"".join(map(self.__getitem__, words))


class Spaced(Ids):
    """Words with their space; the end of a word may hold words without one, which ``bare`` remembers."""

    def __init__(self, encode, cut, code: str, bare: Ids, most: int = MOST):
        super().__init__(encode, cut, code, most)
        self.bare = bare

    def end(self, end) -> bytes:
        found = _TAIL.match(end)
        if not found:
            return super().end(end)
        self.bare.turn()
        return super().end(found[1]) + self.bare[found[2]]


def _signs() -> dict[int, str]:
    """Byte-level models write a byte as the sign of that number, if it is a printable one, else as the next from 256 on."""
    other = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
    return {b: chr(256 + n) for n, b in enumerate(other)}


_SIGNS = _signs()


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def _lowered(word: bytes) -> tuple[bytes, bytes]:
    """The tokenizer lowers letters itself, but for its own marks, which begin with ``<|``."""
    if b"<|" in word:
        return word, b""
    word = word.lower()
    body = word.rstrip(b".,")
    return (body, word[len(body):]) if len(body) < len(word) and _LETTER.search(body) else (word, b"")


def _lettered(word: str) -> tuple[str, str]:
    """The letters at the start, if a sign follows that surely is none; the tokenizer's marks begin with ``<|``."""
    found = None if "<|" in word else _BODY.match(word)
    return found.groups() if found else (word, "")


class SpacelessIds:
    """For tokenizers that drop white space and never join across it: 32-bit ids of whole texts."""

    def __init__(self, path: str):
        tokenizer = _load(path)
        model = tokenizer.model

        def encode(word: bytes, end: bool = False):
            if _PLAIN(word):
                return [t.id for t in model.tokenize(word.decode("latin-1").translate(_SIGNS))]
            return tokenizer.encode(word.decode(), add_special_tokens=False).ids

        self.ids = Ids(encode, _lowered, "I", MOST // 3)

    def __call__(self, text: str | None) -> bytes:
        return self.ids.of((text or "").encode().split())


class ByteLevelIds:
    """For byte-level tokenizers whose words begin with their space: ids of whole texts in ``width`` bytes.

    The pre-tokenizer always begins a piece at a space before a sign that is not white
    space, and after a run of letters.
    """

    def __init__(self, path: str, end_id: int):
        tokenizer = _load(path)
        self.width = 2 if max(tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        model, space = tokenizer.model, _SIGNS[0x20]

        def encode(word: str, bare: bool = False):
            if _LETTERS(word):
                piece = word.encode().decode("latin-1").translate(_SIGNS)
                return [t.id for t in model.tokenize(piece if bare else space + piece)]
            return tokenizer.encode(word if bare else f" {word}", add_special_tokens=False).ids

        self.bare = Ids(lambda word, end=False: encode(word, True), _lettered, self.code, MOST // 4)
        self.ids = Spaced(encode, _lettered, self.code, self.bare)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        parts = _CUT.split(text) if _ODD.search(text) else text.split(" ")
        self.bare.turn()
        first = self.bare[parts[0]] if parts[0] else b""
        return first + self.ids.of(parts[1:])
