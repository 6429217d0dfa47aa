"""Python 3."""

from __future__ import annotations

import re

from repoloom.llm.grammars.base import Error, Parser, Problem

_BLANK = re.compile(r"[ \t\f]*")
_SKIP = re.compile(r"(?:[ \t\f]+|\\(?:\r\n|\n|\r)|#[^\n\r]*)+")
_NEWLINE = re.compile(r"\r\n|\n|\r")
_STRING = re.compile(r"(?i)(?P<prefix>(?:rb|br|rf|fr|[rbuf])?)(?P<quote>\"\"\"|'''|\"|')")
_TOKEN = re.compile(
    r"(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))"
    r"|(?P<name>[^\W\d]\w*)"
    r"|(?P<mark>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|<<|>>|<=|>=|==|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>()\[\]{},:.;=])"
)
#: Reserved words. Fixed values.
_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_BINARY = {"or": 1, "and": 2, "in": 4, "is": 4, "<": 4, ">": 4, "==": 4, ">=": 4, "<=": 4, "!=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10}
_AUGMENT = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_EXPRESSION = frozenset("NAME NUM STR ( [ { - + ~ not lambda await None True False ... yield".split())
#: What an expression can be on the left of an assignment: one place, several places, a starred place, none.
PLACE, PLACES, STARRED, VALUE = range(4)


def _string_end(text: str, at: int, quote: str, formatted: bool, raw: bool) -> int:
    """The offset behind a string's closing quote, or -1."""
    n, size = len(text), len(quote)
    depth = 0
    while at < n:
        c = text[at]
        if formatted and depth:
            if c in "\"'":
                m = _STRING.match(text, at)
                inner = m["quote"]
                if size == 1 and inner == quote or size == 3 and inner == quote:
                    close = text.find("}", at)
                    again = _string_end(text, at + len(inner), inner, True, False)
                    if again == -1 or close == -1:
                        return at + size
                    at = again
                    continue
                at = _string_end(text, at + len(inner), inner, True, False)
                if at == -1:
                    return -1
                continue
            if c in "{[(":
                depth += 1
            elif c in "}])":
                depth -= 1
            elif c in "\n\r" and size == 1 and False:
                return -1
            at += 1
            continue
        if c == "\\":
            at += 3 if text.startswith("\r\n", at + 1) else 2
            continue
        if text.startswith(quote, at):
            return at + size
        if c in "\n\r" and size == 1:
            return -1
        if formatted and c == "{":
            if text.startswith("{{", at):
                at += 2
                continue
            depth = 1
        at += 1
    return -1


#: The commonest tokens, with blanks before them: a name that is no prefix of a string, or a mark that begins no longer one.
_COMMON = re.compile(r"[ \t]*(?:([A-Za-z_]\w*+)(?![\"'])|([()\[\]{},]|\.(?![\d.])|=(?!=)|:(?!=)))")
_CLOSES = {"(": ")", "[": "]", "{": "}"}


def parse_python(text: str) -> list[Error]:
    """Errors of a module."""
    k: list[str] = []
    v: list[str] = []
    p: list[int] = []
    errors: list[Error] = []
    at, n = 1 if text.startswith("﻿") else 0, len(text)
    indents, depth, opened = [0], 0, []
    start_of_line = True

    def put(kind: str, value: str, where: int) -> None:
        k.append(kind), v.append(value), p.append(where)

    common, add_k, add_v, add_p = _COMMON.match, k.append, v.append, p.append
    while at < n:
        if start_of_line:
            m = _BLANK.match(text, at)
            end = m.end()
            if end < n and text[end] == "#":
                end = (_NEWLINE.search(text, end) or re.compile(r"\Z").search(text, end)).start()
            nl = _NEWLINE.match(text, end)
            if nl or end >= n:
                at = nl.end() if nl else n
                continue
            width = 0
            for c in m[0]:
                width = width + 1 if c == " " else (width // 8 + 1) * 8 if c == "\t" else 0
            at = m.end()
            if text.startswith("\\", at) and _NEWLINE.match(text, at + 1):
                at = _NEWLINE.match(text, at + 1).end()
                continue
            if width > indents[-1]:
                indents.append(width)
                put("INDENT", "indent", at)
            else:
                while width < indents[-1]:
                    indents.pop()
                    put("DEDENT", "unindent", at)
                if width != indents[-1]:
                    errors.append(Error(at, "unindent does not match any outer level"))
                    indents.append(width)
            start_of_line = False
        m = common(text, at)
        if m:
            value = m[1]
            if value:
                add_k(value if value in _KEYWORDS else "NAME"), add_v(value), add_p(m.start(1))
            else:
                value = m[2]
                if value in _CLOSES:
                    depth += 1
                    opened.append(value)
                elif value in ")]}":
                    if not opened or _CLOSES[opened[-1]] != value:
                        errors.append(Error(m.start(2), f"unmatched {value}"))
                    if opened:
                        opened.pop()
                        depth -= 1
                add_k(value), add_v(value), add_p(m.start(2))
            at = m.end()
            continue
        m = _SKIP.match(text, at)
        if m:
            at = m.end()
            continue
        nl = _NEWLINE.match(text, at)
        if nl:
            if depth == 0:
                put("NEWLINE", "end of line", at)
                start_of_line = True
            at = nl.end()
            continue
        c = text[at]
        m = _STRING.match(text, at)
        if m:
            prefix = m["prefix"].lower()
            end = _string_end(text, m.end(), m["quote"], "f" in prefix, "r" in prefix)
            if end == -1:
                errors.append(Error(at, "unterminated string"))
                put("STR", "string", at)
                stop = _NEWLINE.search(text, at) if len(m["quote"]) == 1 else None
                at = stop.start() if stop else n
                continue
            put("STR", "string", at)
            at = end
            continue
        m = _TOKEN.match(text, at)
        if m is None:
            errors.append(Error(at, f"no token: {c!r}"))
            put("BAD", c, at)
            at += 1
            continue
        kind, value = m.lastgroup, m[0]
        at = m.end()
        if kind == "name":
            put(value if value in _KEYWORDS else "NAME", value, m.start())
        elif kind == "num":
            nxt = re.compile(r"[^\W\d]\w*").match(text, at)
            if nxt and nxt[0] not in ("if", "else", "and", "or", "in", "is", "for", "not") or re.fullmatch(r"0\d*[1-9]\d*", value):
                errors.append(Error(m.start(), "invalid number"))
            put("NUM", value, m.start())
        else:
            put(value, value, m.start())
    if depth:
        errors.append(Error(n, f"{opened[-1]} was never closed"))
    if k and k[-1] != "NEWLINE":
        put("NEWLINE", "end of line", n)
    for _ in indents[1:]:
        put("DEDENT", "unindent", n)
    for _ in range(3):
        put("EOF", "end of file", n)
    parser = _Py(k, v, p, errors)
    parser.module()
    return sorted(parser.errors, key=lambda e: e.at)


class _Py(Parser):
    def module(self) -> None:
        while self.k[self.i] != "EOF":
            start = self.i
            try:
                if self.accept("INDENT"):
                    raise Problem("unexpected indent")
                if self.accept("DEDENT"):
                    continue
                self.statement()
            except Problem as problem:
                self.note(problem)
                self.recover(frozenset(("NEWLINE",)), start)
            except RecursionError:
                self.note(Problem("nested too deeply"))
                return

    def statement(self) -> None:
        kind = self.k[self.i]
        if kind == "if":
            self.i += 1
            self.named()
            self.suite()
            while self.accept("elif"):
                self.named()
                self.suite()
            if self.accept("else"):
                self.suite()
        elif kind == "while":
            self.i += 1
            self.named()
            self.suite()
            if self.accept("else"):
                self.suite()
        elif kind == "for":
            self.for_()
        elif kind == "try":
            self.try_()
        elif kind == "with":
            self.with_()
        elif kind == "def":
            self.def_()
        elif kind == "class":
            self.i += 1
            self.expect("NAME")
            self.type_parameters()
            if self.k[self.i] == "(":
                self.arguments()
            self.suite()
        elif kind == "async":
            self.i += 1
            nxt = self.k[self.i]
            if nxt == "def":
                self.def_()
            elif nxt == "for":
                self.for_()
            elif nxt == "with":
                self.with_()
            else:
                raise self.fail("def, for or with")
        elif kind == "@":
            while self.accept("@"):
                self.named()
                self.expect("NEWLINE")
            if self.k[self.i] not in ("def", "class", "async"):
                raise self.fail("def or class")
            self.statement()
        elif kind == "NAME" and self.v[self.i] == "match" and self.is_match():
            self.match()
        else:
            self.simple_line()

    def simple_line(self) -> None:
        while True:
            self.simple()
            if self.accept(";"):
                if self.accept("NEWLINE"):
                    return
                continue
            self.expect("NEWLINE")
            return

    def suite(self) -> None:
        self.expect(":")
        if not self.accept("NEWLINE"):
            self.simple_line()
            return
        if not self.accept("INDENT"):
            raise Problem("expected an indented block")
        while not self.accept("DEDENT"):
            if self.k[self.i] == "EOF":
                return
            if self.k[self.i] == "INDENT":
                raise Problem("unexpected indent")
            self.statement()

    def for_(self) -> None:
        self.i += 1
        self.targets("in")
        self.expect("in")
        self.star_expressions()
        self.suite()
        if self.accept("else"):
            self.suite()

    def targets(self, stop: str) -> None:
        """A list of places up to ``stop``."""
        count = 0
        while True:
            star = self.accept("*")
            if self.binary(4) > STARRED - 1 and not star:
                raise Problem("cannot be assigned to")
            count += 1
            if not self.accept(","):
                return
            if self.k[self.i] == stop:
                return

    def try_(self) -> None:
        self.i += 1
        self.suite()
        handled = False
        while self.accept("except"):
            handled = True
            self.accept("*")
            if self.k[self.i] != ":":
                self.expression()
                while self.accept(","):
                    self.expression()
                if self.accept("as"):
                    self.expect("NAME")
            self.suite()
        if handled and self.accept("else"):
            self.suite()
        if self.accept("finally"):
            handled = True
            self.suite()
        if not handled:
            raise Problem("expected 'except' or 'finally' block")

    def with_(self) -> None:
        self.i += 1
        start = self.i
        if self.accept("("):
            try:
                while True:
                    self.with_item()
                    if not self.accept(",") or self.k[self.i] == ")":
                        break
                self.expect(")")
                if self.k[self.i] == ":":
                    self.suite()
                    return
            except Problem:
                pass
            self.i = start
        while True:
            self.with_item()
            if not self.accept(","):
                break
        self.suite()

    def with_item(self) -> None:
        self.expression()
        if self.accept("as"):
            if self.accept("*") or self.binary(4) > PLACES:
                raise Problem("cannot be assigned to")

    def type_parameters(self) -> None:
        if self.accept("["):
            while True:
                if not self.accept("*"):
                    self.accept("**")
                self.expect("NAME")
                if self.accept(":"):
                    self.expression()
                if self.accept("="):
                    self.star_or_expression()
                if not self.accept(",") or self.k[self.i] == "]":
                    break
            self.expect("]")

    def def_(self) -> None:
        self.i += 1
        self.expect("NAME")
        self.type_parameters()
        self.expect("(")
        self.parameters(")", True)
        self.expect(")")
        if self.accept("->"):
            self.star_expressions()
        self.suite()

    def parameters(self, stop: str, annotated: bool) -> None:
        default = star = slash = False
        seen = 0
        while self.k[self.i] != stop:
            if self.accept("**"):
                self.expect("NAME")
                if annotated and self.accept(":"):
                    self.expression()
                self.accept(",")
                if self.k[self.i] != stop:
                    raise Problem("parameters behind **")
                return
            if self.accept("/"):
                if slash or star or not seen:
                    raise Problem("misplaced /")
                slash = True
            elif self.accept("*"):
                if star:
                    raise Problem("* twice")
                star = True
                if self.k[self.i] == "NAME":
                    self.i += 1
                    if annotated and self.accept(":"):
                        self.star_or_expression()
                elif self.k[self.i] != ",":
                    raise self.fail("name")
                elif self.k[self.i + 1] in (stop, "**"):
                    raise Problem("named parameters must follow *")
            else:
                self.expect("NAME")
                seen += 1
                if annotated and self.accept(":"):
                    self.expression()
                if self.accept("="):
                    self.expression()
                    default = True
                elif default and not star:
                    raise Problem("parameter without a default follows one with a default")
            if self.k[self.i] != stop:
                self.expect(",")

    def is_match(self) -> bool:
        k, i, depth = self.k, self.i + 1, 0
        if k[i] in ("NEWLINE", "=", ".", ",", ")", ":"):
            return False
        while k[i] not in ("NEWLINE", "EOF"):
            i += 1
        return k[i - 1] == ":" and k[i] == "NEWLINE" and k[i + 1] == "INDENT" and k[i + 2] == "NAME" and self.v[i + 2] == "case" and depth == 0

    def match(self) -> None:
        self.i += 1
        self.star_expressions()
        self.expect(":")
        self.expect("NEWLINE")
        self.expect("INDENT")
        while not self.accept("DEDENT"):
            if not (self.k[self.i] == "NAME" and self.v[self.i] == "case"):
                raise self.fail("case")
            self.i += 1
            self.pattern_list(":", "if")
            if self.accept("if"):
                self.named()
            self.suite()

    def pattern_list(self, *stops: str) -> None:
        while True:
            if self.accept("*"):
                self.expect("NAME")
            else:
                self.pattern()
            if not self.accept(",") or self.k[self.i] in stops:
                return

    def pattern(self) -> None:
        self.closed_pattern()
        while self.accept("|"):
            self.closed_pattern()
        if self.accept("as"):
            self.expect("NAME")

    def closed_pattern(self) -> None:
        kind = self.k[self.i]
        if kind in ("-", "NUM"):
            self.accept("-")
            self.expect("NUM")
            if self.k[self.i] in ("+", "-"):
                self.i += 1
                self.expect("NUM")
        elif kind == "STR":
            while self.accept("STR"):
                pass
        elif kind in ("None", "True", "False"):
            self.i += 1
        elif kind == "NAME":
            self.i += 1
            while self.accept("."):
                self.expect("NAME")
            if self.accept("("):
                while self.k[self.i] != ")":
                    if self.k[self.i] == "NAME" and self.k[self.i + 1] == "=":
                        self.i += 2
                    self.pattern()
                    if self.k[self.i] != ")":
                        self.expect(",")
                self.expect(")")
        elif kind in ("(", "["):
            close = ")" if kind == "(" else "]"
            self.i += 1
            if self.k[self.i] != close:
                self.pattern_list(close)
            self.expect(close)
        elif kind == "{":
            self.i += 1
            while self.k[self.i] != "}":
                if self.accept("**"):
                    self.expect("NAME")
                else:
                    self.closed_pattern()
                    self.expect(":")
                    self.pattern()
                if self.k[self.i] != "}":
                    self.expect(",")
            self.expect("}")
        else:
            raise self.fail("pattern")

    def simple(self) -> None:
        kind = self.k[self.i]
        if kind in ("pass", "break", "continue"):
            self.i += 1
        elif kind == "return":
            self.i += 1
            if self.k[self.i] not in ("NEWLINE", ";"):
                self.star_expressions()
        elif kind == "raise":
            self.i += 1
            if self.k[self.i] not in ("NEWLINE", ";"):
                self.expression()
                if self.accept("from"):
                    self.expression()
        elif kind in ("global", "nonlocal"):
            self.i += 1
            self.expect("NAME")
            while self.accept(","):
                self.expect("NAME")
        elif kind == "del":
            self.i += 1
            if self.star_expressions() > PLACES:
                raise Problem("cannot be deleted")
        elif kind == "assert":
            self.i += 1
            self.expression()
            if self.accept(","):
                self.expression()
        elif kind == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.accept("as"):
                    self.expect("NAME")
                if not self.accept(","):
                    return
        elif kind == "from":
            self.from_()
        elif kind == "NAME" and self.v[self.i] == "type" and self.k[self.i + 1] == "NAME" and self.k[self.i + 2] in ("=", "["):
            self.i += 2
            self.type_parameters()
            self.expect("=")
            self.expression()
        else:
            self.expression_statement()

    def dotted(self) -> None:
        self.expect("NAME")
        while self.accept("."):
            self.expect("NAME")

    def from_(self) -> None:
        self.i += 1
        dots = 0
        while self.k[self.i] in (".", "..."):
            self.i += 1
            dots += 1
        if not dots or self.k[self.i] != "import":
            self.dotted()
        self.expect("import")
        if self.accept("*"):
            return
        closed = self.accept("(")
        while True:
            self.expect("NAME")
            if self.accept("as"):
                self.expect("NAME")
            if not self.accept(","):
                break
            if closed and self.k[self.i] == ")":
                break
        if closed:
            self.expect(")")

    def expression_statement(self) -> None:
        left = self.star_expressions()
        kind = self.k[self.i]
        if kind == ":":
            if left != PLACE:
                raise Problem("only a single target can be annotated")
            self.i += 1
            self.expression()
            if self.accept("="):
                self.star_expressions(True)
        elif kind in _AUGMENT:
            if left != PLACE:
                raise Problem("cannot be assigned to")
            self.i += 1
            self.star_expressions(True)
        else:
            while self.k[self.i] == "=":
                if left > PLACES:
                    raise Problem("cannot be assigned to")
                self.i += 1
                left = self.star_expressions(True)

    def star_or_expression(self) -> int:
        if self.accept("*"):
            return STARRED if self.binary(4) <= PLACES else VALUE
        return self.expression()

    def star_expressions(self, _value: bool = False) -> int:
        if self.k[self.i] == "yield":
            self.yield_()
            return VALUE
        first = self.star_or_expression()
        if self.k[self.i] != ",":
            return first
        places = first <= STARRED
        while self.accept(","):
            if self.k[self.i] not in _EXPRESSION and self.k[self.i] != "*":
                break
            places = self.star_or_expression() <= STARRED and places
        return PLACES if places else VALUE

    def yield_(self) -> None:
        self.i += 1
        if self.accept("from"):
            self.expression()
        elif self.k[self.i] in _EXPRESSION or self.k[self.i] == "*":
            self.star_expressions()

    def named(self) -> int:
        if self.k[self.i] == "NAME" and self.k[self.i + 1] == ":=":
            self.i += 2
            self.expression()
            return VALUE
        return self.expression()

    def expression(self) -> int:
        if self.k[self.i] == "lambda":
            self.i += 1
            self.parameters(":", False)
            self.expect(":")
            self.expression()
            return VALUE
        kind = self.binary(0)
        if self.k[self.i] == "if":
            self.i += 1
            self.binary(0)
            self.expect("else")
            self.expression()
            return VALUE
        return kind

    def binary(self, least: int) -> int:
        if self.k[self.i] == "not":
            if least >= 4:
                raise self.fail("operand")
            self.i += 1
            self.binary(3)
            kind = VALUE
        else:
            kind = self.unary()
        k = self.k
        while True:
            op = k[self.i]
            power = _BINARY.get(op)
            if power is None:
                if op == "not" and k[self.i + 1] == "in" and least < 4:
                    self.i += 2
                    self.binary(4)
                    kind = VALUE
                    continue
                return kind
            if power <= least:
                return kind
            self.i += 1
            if op == "is":
                self.accept("not")
            self.binary(power)
            kind = VALUE

    def unary(self) -> int:
        if self.k[self.i] in ("-", "+", "~"):
            while self.k[self.i] in ("-", "+", "~"):
                self.i += 1
            self.power()
            return VALUE
        return self.power()

    def power(self) -> int:
        awaited = self.accept("await")
        kind = self.primary()
        if self.accept("**"):
            self.unary()
            return VALUE
        return VALUE if awaited else kind

    def primary(self) -> int:
        kind = self.atom()
        k = self.k
        while True:
            nxt = k[self.i]
            if nxt == ".":
                self.i += 1
                self.expect("NAME")
                kind = PLACE
            elif nxt == "(":
                self.arguments()
                kind = VALUE
            elif nxt == "[":
                self.i += 1
                self.slices()
                self.expect("]")
                kind = PLACE
            else:
                return kind

    def slices(self) -> None:
        while True:
            if self.k[self.i] == "*":
                self.star_or_expression()
            else:
                if self.k[self.i] != ":":
                    self.named()
                if self.accept(":"):
                    if self.k[self.i] not in (":", "]", ","):
                        self.expression()
                    if self.accept(":") and self.k[self.i] not in ("]", ","):
                        self.expression()
            if not self.accept(",") or self.k[self.i] == "]":
                return

    def arguments(self) -> None:
        self.expect("(")
        named = double = False
        count = 0
        while self.k[self.i] != ")":
            if self.accept("**"):
                self.expression()
                double = True
            elif self.accept("*"):
                if double:
                    raise Problem("* behind **")
                self.expression()
            elif self.k[self.i] == "NAME" and self.k[self.i + 1] == "=":
                self.i += 2
                self.expression()
                named = True
            else:
                self.named()
                if self.k[self.i] in ("for", "async"):
                    self.comprehension()
                    if count or self.k[self.i] == "," and self.k[self.i + 1] != ")":
                        raise Problem("a generator must be in parentheses")
                elif named or double:
                    raise Problem("positional argument follows keyword argument")
            count += 1
            if self.k[self.i] != ")":
                self.expect(",")
        self.i += 1

    def comprehension(self) -> None:
        while self.k[self.i] in ("for", "async"):
            self.accept("async")
            self.expect("for")
            self.targets("in")
            self.expect("in")
            self.binary(0)
            while self.accept("if"):
                if self.k[self.i] == "NAME" and self.k[self.i + 1] == ":=":
                    self.i += 2
                self.binary(0)

    def atom(self) -> int:
        kind = self.k[self.i]
        if kind == "NAME":
            self.i += 1
            return PLACE
        if kind in ("NUM", "None", "True", "False", "..."):
            self.i += 1
            return VALUE
        if kind == "STR":
            while self.accept("STR"):
                pass
            return VALUE
        if kind == "(":
            self.i += 1
            if self.accept(")"):
                return PLACES
            if self.k[self.i] == "yield":
                self.yield_()
                self.expect(")")
                return VALUE
            star = self.k[self.i] == "*"
            places = self.element()
            if self.k[self.i] in ("for", "async"):
                if star:
                    raise Problem("starred element in a comprehension")
                self.comprehension()
                self.expect(")")
                return VALUE
            if self.k[self.i] != ",":
                if star:
                    raise Problem("starred expression outside of a tuple")
                self.expect(")")
                return places
            places = self.elements(")", places)
            self.expect(")")
            return places
        if kind == "[":
            self.i += 1
            if self.accept("]"):
                return PLACES
            places = self.element()
            if self.k[self.i] in ("for", "async"):
                self.comprehension()
                self.expect("]")
                return VALUE
            places = self.elements("]", places)
            self.expect("]")
            return places
        if kind == "{":
            self.braces()
            return VALUE
        raise self.fail("expression")

    def element(self) -> int:
        return self.star_or_expression() if self.k[self.i] == "*" else self.named()

    def elements(self, close: str, first: int) -> int:
        places = first <= STARRED
        while self.accept(","):
            if self.k[self.i] == close:
                break
            places = self.element() <= STARRED and places
        return PLACES if places else VALUE

    def braces(self) -> None:
        self.expect("{")
        if self.accept("}"):
            return
        pairs = None
        while True:
            if self.accept("**"):
                if pairs is False:
                    raise Problem("** in a set")
                pairs = True
                self.binary(4)
            elif self.k[self.i] == "*":
                if pairs:
                    raise Problem("* in a dictionary")
                pairs = False
                self.star_or_expression()
            else:
                self.named()
                pair = self.accept(":")
                if pairs is not None and pair != pairs:
                    raise self.fail(":" if pairs else ",")
                pairs = pair
                if pair:
                    self.expression()
                if self.k[self.i] in ("for", "async"):
                    self.comprehension()
                    break
            if not self.accept(",") or self.k[self.i] == "}":
                break
        self.expect("}")
