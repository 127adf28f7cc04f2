"""Texts cut where tokenizers cut them anyway, so that a piece is encoded once for all the places it stands in.

A piece begins at a single space or line feed between two characters that aren't white space. Byte-level pre-tokenizers
match no white space after another character, and the pieces of sentence models hold no word mark but at their beginning
and no line feed, so the ids of a text are those of its pieces in a row. Other white space stays inside a piece. A text
without such places is one piece.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

CUT = re.compile(r"(?=[ \n]\S)(?<=\S)")
CHUNK = 1 << 20
#: Pieces that a Python worker keeps, and the longest that are: up to some 200 MB.
KEPT, LONG = 1 << 20, 64
#: Marks that no pre-tokenizer joins to a letter before them.
TAIL = ",.;:!?)"


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """A text in parts of about so many characters, cut where a piece begins."""
    at = 0
    while len(text) - at > size:
        m = CUT.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class Kept(dict):
    """What ``make`` gives for a piece, made when it is first asked for. Long pieces aren't kept, and all go when there are too many."""

    def __init__(self, make: Callable[[str], object], most: int = KEPT):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, piece: str):
        value = self.make(piece)
        if len(piece) <= LONG:
            if len(self) >= self.most:
                self.clear()
            self[piece] = value
        return value

    def of(self, chunk: str) -> Iterator:
        return map(self.__getitem__, CUT.split(chunk))


def _tokenizer(config: str, plain: bool):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(config)
    t.encode_special_tokens = plain
    return t


def byte_bpe(config: str, plain: bool) -> Callable[[str], list[int]]:
    """Ids of a text by a tokenizers file's content. plain: the strings of special tokens are ordinary text."""
    t = _tokenizer(config, plain)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def byte_bpe_batch(config: str, plain: bool) -> Callable[[list[str]], list[list[int]]]:
    """The same for many texts."""
    t = _tokenizer(config, plain)
    return lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def packed_ids(config: str, code: str) -> Kept:
    """Pieces to their ids as bytes, ``code`` being an array's type. A word's closing marks are a piece of their own."""
    encode = byte_bpe(config, plain=False)

    def make(piece: str) -> bytes:
        word = piece.rstrip(TAIL)
        if word != piece and word[-1:].isalpha():
            return kept[word] + kept[piece[len(word) :]]
        return array(code, encode(piece)).tobytes()

    kept = Kept(make)
    return kept
