"""Splitting texts at spaces so that the pieces tokenize independently of each other.

GPT-2 style patterns attach one leading space to the word after it. A space that stands between
two non-spaces therefore always begins a new match, and the text's tokens are the concatenation of
its pieces' tokens. Natural text repeats its pieces, so a worker encodes each distinct one once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

from plumbline.llm.common import memo

#: A space with white space on both sides: the one case in which a piece's neighbours matter.
_AMBIGUOUS = re.compile(r"\s \s")


def space_keys(text: str) -> list[str]:
    """Keys of the pieces of ``text``, cut before each space, or before fewer of them where white
    space runs make that unsafe.

    A piece that is one space and a word has the word as its key; any other has a space before it.
    """
    if "  " in text or _AMBIGUOUS.search(text):
        return [p[1:] if p[0] == " " and p.count(" ") == 1 else " " + p for p in _runs(text)]
    keys = text.split(" ")
    keys[0] = " " + keys[0]
    return keys


def piece_of(key: str) -> str:
    return key[1:] if key[:1] == " " else " " + key


def _runs(text: str) -> list[str]:
    """Cut only before spaces that follow a non-space or precede one."""
    return [x for x in re.split(r"(?<=\S)(?= )|(?= \S)", text) if x]


class PieceMemo:
    """Encoded bytes of pieces, each distinct piece encoded once while it stays in the memo.

    ``encode`` maps a list of pieces to a list of little-endian id bytes. The memo is emptied when
    it holds ``limit`` pieces, so its memory is bounded whatever the corpus. The strings in ``apart``
    are pieces wherever they stand, and what is between them is cut as a text of its own.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], owner: str, limit: int = 1_200_000, apart: Iterable[str] = ()):
        self.encode, self.owner, self.limit, self.known = encode, owner, limit, {}
        self.apart = sorted(apart, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, self.apart))})")

    def keys(self, text: str) -> list[str]:
        if not any(x in text for x in self.apart):
            return space_keys(text)
        parts = self.cut.split(text)
        return [k for i, part in enumerate(parts) if part for k in ([" " + part] if i % 2 else space_keys(part))]

    def ids(self, texts: Iterable[str], together: int = 512) -> Iterator[bytes]:
        """The ids of each text; new pieces of ``together`` texts are encoded in one call."""
        texts, self.known = iter(texts), memo(self.owner, "pieces")
        while group := [self.keys(t) for t in islice(texts, together)]:
            new = set().union(*group).difference(self.known)
            if new:
                if len(self.known) + len(new) > self.limit:
                    self.known.clear()
                    new = set().union(*group)
                found = list(new)
                self.known.update(zip(found, self.encode(list(map(piece_of, found))), strict=True))
            get = self.known.__getitem__
            for keys in group:
                yield b"".join(map(get, keys))
