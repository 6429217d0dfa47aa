"""What the parsers share: token cursor, errors and recovery."""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Error:
    """A syntax error at a code point, with the cause in words."""

    at: int
    message: str


def any_depth(parse: Callable[[str], list[Error]]) -> Callable[[str], list[Error]]:
    """Lets a parser recurse as deep as its text can nest: a level takes a character at least, and fewer than 100 calls."""

    @functools.wraps(parse)
    def deep(text: str) -> list[Error]:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(min(limit + 100 * len(text), 2**31 - 1))
        try:
            return parse(text)
        finally:
            sys.setrecursionlimit(limit)

    return deep


class Problem(Exception):
    """Raised inside a statement; caught where the parser can start afresh."""


class Parser:
    """A cursor over tokens. ``k`` holds kinds (a mark or keyword is its own kind), ``v`` texts, ``p`` offsets."""

    def __init__(self, k: list[str], v: list[str], p: list[int], errors: list[Error]) -> None:
        self.k, self.v, self.p, self.i, self.errors = k, v, p, 0, errors

    def fail(self, wanted: str) -> Problem:
        got = self.v[self.i] if self.k[self.i] != "EOF" else "end of file"
        return Problem(f"expected {wanted}, got {got[:30]!r}")

    def note(self, problem: Exception) -> None:
        self.errors.append(Error(self.p[self.i], str(problem)))

    def accept(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def expect(self, kind: str) -> None:
        if self.k[self.i] != kind:
            raise self.fail(kind)
        self.i += 1

    def recover(self, stops: frozenset[str], start: int) -> None:
        """Panic mode: skip to behind the next token of ``stops``, always past ``start``."""
        if self.i <= start:
            self.i = start + 1
        k, n = self.k, len(self.k) - 1
        while self.i < n and k[self.i] not in stops:
            self.i += 1
        if self.i < n:
            self.i += 1
        self.i = min(self.i, n)
