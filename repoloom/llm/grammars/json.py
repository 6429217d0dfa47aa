"""JSON (RFC 8259)."""

from __future__ import annotations

import re

from repoloom.llm.grammars.base import Error, Parser, Problem

_TOKEN = re.compile(r'[ \t\r\n]+|("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(true|false|null)(?!\w)|([{}\[\]:,])')


def parse_json(text: str) -> list[Error]:
    """Errors of a JSON text; a byte order mark in front is allowed."""
    errors: list[Error] = []
    k, v, p = [], [], []
    at, n = 1 if text.startswith("﻿") else 0, len(text)
    while at < n:
        m = _TOKEN.match(text, at)
        if m is None:
            errors.append(Error(at, f"no JSON token: {text[at : at + 20]!r}"))
            k.append("BAD"), v.append(text[at]), p.append(at)
            nxt = re.compile(r"[\s{}\[\]:,]").search(text, at + 1)
            at = nxt.start() if nxt else n
            continue
        if m.lastindex:
            k.append(m[0] if m.lastindex == 4 else "STR" if m.lastindex == 1 else "LIT"), v.append(m[0]), p.append(at)
        at = m.end()
    k.append("EOF"), v.append(""), p.append(n)
    parser = _Json(k, v, p, errors)
    parser.document()
    return sorted(parser.errors, key=lambda e: e.at)


class _Json(Parser):
    def document(self) -> None:
        try:
            self.value()
            if self.k[self.i] != "EOF":
                raise self.fail("end of file")
        except Problem as problem:
            self.note(problem)

    def value(self) -> None:
        # an explicit stack: nesting may be deep
        stack: list[str] = []
        while True:
            kind = self.k[self.i]
            if kind == "{":
                self.i += 1
                if self.accept("}"):
                    pass
                else:
                    self.key()
                    stack.append("}")
                    continue
            elif kind == "[":
                self.i += 1
                if self.accept("]"):
                    pass
                else:
                    stack.append("]")
                    continue
            elif kind in ("STR", "LIT"):
                self.i += 1
            else:
                raise self.fail("value")
            while stack:
                if self.accept(","):
                    if stack[-1] == "}":
                        self.key()
                    break
                self.expect(stack.pop())
            else:
                return

    def key(self) -> None:
        self.expect("STR")
        self.expect(":")
