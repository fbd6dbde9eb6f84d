"""Texts as pieces of the byte-level pattern, with what was encoded before remembered."""

from __future__ import annotations

import re

import regex

#: Pieces that a worker's younger memory holds; when it is full it becomes the older one, whose entries come back when
#: asked for, and the rest is forgotten. Results don't depend on it.
REMEMBERED = 200_000
#: Longer pieces are not remembered.
LONGEST = 64
#: Anything but ASCII and the letters (and two signs) from U+00C0 to U+024F.
RARE = re.compile("[^\n\r\t\x20-\x7eÀ-ɏ]")


def plain(pattern: str) -> str:
    """The pattern for the standard library, which is faster but lacks \\p: for texts without RARE characters."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")


class Pieces(dict):
    """Piece -> its ids packed as little-endian unsigned 32-bit integers; subclasses say how one is made."""

    def __init__(self, pattern: str, remembered: int = REMEMBERED):
        super().__init__()
        self.remembered = remembered
        self.older: dict = {}
        self.any, self.common = regex.compile(pattern).findall, re.compile(plain(pattern)).findall

    def made(self, piece: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = self.made(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.remembered:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out

    def split(self, text: str) -> list[str]:
        """The pieces that are encoded one by one."""
        return self.any(text) if RARE.search(text) else self.common(text)

    def encode(self, text: str) -> bytes:
        """The text's ids, packed."""
        return b"".join(map(self.__getitem__, self.split(text)))
