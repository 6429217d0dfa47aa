"""Java (language level 21)."""

from __future__ import annotations

import re

from repoloom.llm.grammars.base import Error, Parser, Problem, any_depth

_TOKEN = re.compile(
    r"(?P<space>(?:\s+|//[^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/)+)"
    r"|(?P<block>\"\"\"[ \t\f]*(?:\r\n|\n|\r)(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\")"
    r"|(?P<str>\"(?:[^\"\\\n\r]|\\(?:[btnfrs0-7\"'\\]|u+[0-9a-fA-F]{4}))*\")"
    r"|(?P<char>'(?:[^'\\\n\r]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))')"
    r"|(?P<num>(?:0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?\d+[fFdD]?|0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*[lL]?|0[bB][01](?:_*[01])*[lL]?|\d(?:_*\d)*\.(?:\d(?:_*\d)*)?(?:[eE][+-]?\d+)?[fFdD]?|\.\d(?:_*\d)*(?:[eE][+-]?\d+)?[fFdD]?|\d(?:_*\d)*(?:[eE][+-]?\d+)?[lLfFdD]?)(?![\w$]))"
    r"|(?P<name>(?:[^\W\d]|\$)[\w$]*)"
    r"|(?P<mark>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[{}()\[\];,.@=<>!~?:+\-*/&|^%])"
)
#: Reserved words. Fixed values.
_KEYWORDS = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
_PRIMITIVE = frozenset("boolean byte char short int long float double".split())
_MODIFIER = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
_BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
_ASSIGN = frozenset("= += -= *= /= &= |= ^= %= <<= >>= >>>=".split())
_STOPS = frozenset(";}")


@any_depth
def parse_java(text: str) -> list[Error]:
    """Errors of a compilation unit."""
    k: list[str] = []
    v: list[str] = []
    p: list[int] = []
    errors: list[Error] = []
    at, n = 0, len(text)
    if text.startswith("\ufeff"):
        at = 1
    match = _TOKEN.match
    while at < n:
        m = match(text, at)
        if m is None:
            rest = text[at:]
            if rest == "\x1a":
                break
            errors.append(Error(at, f"no token: {text[at : at + 20]!r}"))
            if text.startswith("/*", at):
                break
            k.append("BAD"), v.append(text[at]), p.append(at)
            stop = re.compile(r"[\n\r]").search(text, at) if text[at] in "\"'" else None
            at = stop.start() if stop else n if text[at] in "\"'" else at + 1
            continue
        kind = m.lastgroup
        if kind != "space":
            value = m[0]
            k.append(value if kind == "mark" or kind == "name" and value in _KEYWORDS else "NAME" if kind == "name" else "LIT")
            v.append(value), p.append(at)
        at = m.end()
    for _ in range(4):
        k.append("EOF"), v.append(""), p.append(n)
    parser = _Java(k, v, p, errors)
    parser.unit()
    return sorted(parser.errors, key=lambda e: e.at)


class _Java(Parser):
    def word(self, text: str) -> bool:
        return self.k[self.i] == "NAME" and self.v[self.i] == text

    def unit(self) -> None:
        while self.k[self.i] != "EOF":
            start = self.i
            try:
                self.top()
            except Problem as problem:
                self.note(problem)
                self.recover(_STOPS, start)

    def top(self) -> None:
        if self.accept(";"):
            return
        if self.k[self.i] == "import":
            self.i += 1
            self.accept("static")
            self.expect("NAME")
            while self.accept("."):
                if self.accept("*"):
                    break
                self.expect("NAME")
            self.expect(";")
            return
        start = self.i
        self.modifiers()
        if self.k[self.i] == "package":
            self.i += 1
            self.qualified()
            self.expect(";")
        elif self.word("module") or self.word("open") and start == self.i:
            while self.k[self.i] not in ("{", "EOF"):
                self.i += 1
            self.expect("{")
            while not self.accept("}"):
                if self.k[self.i] == "EOF":
                    raise self.fail("}")
                self.i += 1
        elif self.is_type_declaration():
            self.type_declaration()
        else:
            raise self.fail("class, interface, enum or record")

    def qualified(self) -> None:
        self.expect("NAME")
        while self.k[self.i] == "." and self.k[self.i + 1] == "NAME":
            self.i += 2

    def modifiers(self) -> None:
        while True:
            kind = self.k[self.i]
            if kind in _MODIFIER and not (kind == "default" and self.k[self.i + 1] in (":", "->")) and not (kind == "synchronized" and self.k[self.i + 1] == "("):
                self.i += 1
            elif kind == "@" and self.k[self.i + 1] != "interface":
                self.annotation()
            elif self.word("sealed") and self.k[self.i + 1] in ("class", "interface", "abstract", "NAME"):
                self.i += 1
            elif self.word("non") and self.k[self.i + 1] == "-":
                self.i += 3
            else:
                return

    def annotation(self) -> None:
        self.expect("@")
        self.qualified()
        if self.accept("("):
            while not self.accept(")"):
                if self.k[self.i] == "NAME" and self.k[self.i + 1] == "=":
                    self.i += 2
                self.element_value()
                if self.k[self.i] != ")":
                    self.expect(",")

    def element_value(self) -> None:
        if self.k[self.i] == "@":
            self.annotation()
        elif self.accept("{"):
            while not self.accept("}"):
                self.element_value()
                if self.k[self.i] != "}":
                    self.expect(",")
        else:
            self.conditional()

    def is_type_declaration(self) -> bool:
        kind = self.k[self.i]
        return kind in ("class", "interface", "enum") or kind == "@" and self.k[self.i + 1] == "interface" or self.word("record") and self.k[self.i + 1] == "NAME" and self.k[self.i + 2] in ("(", "<")

    def type_declaration(self) -> None:
        kind = self.k[self.i]
        self.i += 2 if kind == "@" else 1
        self.expect("NAME")
        self.type_parameters()
        if kind == "NAME":
            self.parameters()
        while self.k[self.i] in ("extends", "implements") or self.word("permits"):
            self.i += 1
            self.type()
            while self.accept(","):
                self.type()
        self.expect("{")
        if kind == "enum":
            while self.k[self.i] in ("NAME", "@"):
                while self.k[self.i] == "@":
                    self.annotation()
                self.expect("NAME")
                if self.k[self.i] == "(":
                    self.arguments()
                if self.accept("{"):
                    self.members()
                if not self.accept(","):
                    break
            if self.k[self.i] != "}":
                self.expect(";")
        self.members()

    def members(self) -> None:
        while not self.accept("}"):
            if self.k[self.i] == "EOF":
                raise self.fail("}")
            self.member()

    def member(self) -> None:
        if self.accept(";"):
            return
        if self.k[self.i] == "{" or self.k[self.i] == "static" and self.k[self.i + 1] == "{":
            self.accept("static")
            self.block()
            return
        self.modifiers()
        if self.is_type_declaration():
            self.type_declaration()
            return
        self.type_parameters()
        if self.k[self.i] == "NAME" and self.k[self.i + 1] in ("(", "{"):
            self.i += 1
            if self.k[self.i] == "(":
                self.parameters()
            self.throws()
            self.block()
            return
        if not self.accept("void"):
            self.type()
        self.expect("NAME")
        if self.k[self.i] == "(":
            self.parameters()
            self.dimensions()
            self.throws()
            if self.accept("default"):
                self.element_value()
            if not self.accept(";"):
                self.block()
            return
        self.declarators()
        self.expect(";")

    def throws(self) -> None:
        if self.accept("throws"):
            self.type()
            while self.accept(","):
                self.type()

    def dimensions(self) -> bool:
        found = False
        while self.k[self.i] == "[" and self.k[self.i + 1] == "]":
            self.i += 2
            found = True
        return found

    def declarators(self) -> None:
        """What follows the first name of a declaration."""
        while True:
            self.dimensions()
            if self.accept("="):
                self.initializer()
            if not self.accept(","):
                return
            self.expect("NAME")

    def initializer(self) -> None:
        if self.accept("{"):
            while not self.accept("}"):
                self.initializer()
                if self.k[self.i] != "}":
                    self.expect(",")
        else:
            self.expression()

    def type_parameters(self) -> None:
        if not self.accept("<"):
            return
        while True:
            while self.k[self.i] == "@":
                self.annotation()
            self.expect("NAME")
            if self.accept("extends"):
                self.type()
                while self.accept("&"):
                    self.type()
            if not self.accept(","):
                break
        self.expect(">")

    def type(self) -> None:
        while self.k[self.i] == "@":
            self.annotation()
        if self.k[self.i] in _PRIMITIVE:
            self.i += 1
        else:
            while True:
                self.expect("NAME")
                self.type_arguments()
                if self.k[self.i] == "." and self.k[self.i + 1] in ("NAME", "@"):
                    self.i += 1
                    while self.k[self.i] == "@":
                        self.annotation()
                    continue
                break
        self.dimensions()

    def type_arguments(self) -> bool:
        if not self.accept("<"):
            return False
        if self.accept(">"):
            return True
        while True:
            while self.k[self.i] == "@":
                self.annotation()
            if self.accept("?"):
                if self.k[self.i] in ("extends", "super"):
                    self.i += 1
                    self.type()
            else:
                self.type()
            if not self.accept(","):
                break
        self.expect(">")
        return True

    def parameters(self) -> None:
        self.expect("(")
        while not self.accept(")"):
            self.modifiers()
            self.type()
            self.accept("...")
            if self.k[self.i] == "this":
                self.i += 1
            else:
                self.expect("NAME")
                while self.k[self.i] == "." and self.k[self.i + 1] == "this":
                    self.i += 2
            self.dimensions()
            if self.k[self.i] != ")":
                self.expect(",")
                if self.k[self.i] == ")":
                    raise self.fail("parameter")

    def block(self) -> None:
        self.expect("{")
        while self.k[self.i] != "}":
            if self.k[self.i] == "EOF":
                raise self.fail("}")
            self.statement()
        self.i += 1

    def try_local(self) -> bool:
        """A local declaration, if a type and a name stand here; else nothing is consumed."""
        start = self.i
        kind = self.k[start]
        if kind in ("final", "@", "abstract", "static", "class", "interface", "enum") or self.is_type_declaration():
            self.modifiers()
            if self.is_type_declaration():
                self.type_declaration()
                return True
            self.type()
            self.expect("NAME")
            return True
        if kind in _PRIMITIVE:
            self.type()
            if self.k[self.i] in ("::", "."):
                self.i = start
                return False
            self.expect("NAME")
            return True
        if kind != "NAME" or self.k[start + 1] not in ("NAME", "<", ".", "["):
            return False
        try:
            self.type()
        except Problem:
            self.i = start
            return False
        if self.k[self.i] == "NAME" and not self.word("instanceof"):
            self.i += 1
            return True
        self.i = start
        return False

    def statement(self) -> None:
        kind = self.k[self.i]
        if kind == "{":
            self.block()
        elif kind == ";":
            self.i += 1
        elif kind == "if":
            self.i += 1
            self.condition()
            self.statement()
            if self.accept("else"):
                self.statement()
        elif kind == "while":
            self.i += 1
            self.condition()
            self.statement()
        elif kind == "do":
            self.i += 1
            self.statement()
            self.expect("while")
            self.condition()
            self.expect(";")
        elif kind == "for":
            self.for_()
        elif kind == "return":
            self.i += 1
            if self.k[self.i] != ";":
                self.expression()
            self.expect(";")
        elif kind == "throw":
            self.i += 1
            self.expression()
            self.expect(";")
        elif kind in ("break", "continue"):
            self.i += 1
            self.accept("NAME")
            self.expect(";")
        elif kind == "assert":
            self.i += 1
            self.expression()
            if self.accept(":"):
                self.expression()
            self.expect(";")
        elif kind == "synchronized" and self.k[self.i + 1] == "(":
            self.i += 1
            self.condition()
            self.block()
        elif kind == "try":
            self.try_()
        elif kind == "switch":
            self.switch()
            if self.k[self.i] == ".":
                raise self.fail("statement")
        elif kind == "NAME" and self.k[self.i + 1] == ":":
            self.i += 2
            self.statement()
        elif self.word("yield") and self.k[self.i + 1] not in ("=", ".", "(", "[", "++", "--") or self.word("yield") and self.k[self.i + 1] == "(":
            self.i += 1
            self.expression()
            self.expect(";")
        else:
            start = self.i
            if self.try_local():
                if self.k[self.i - 1] == "}":
                    return
                self.declarators()
                self.expect(";")
                return
            self.expression()
            if not self.effect(start):
                raise Problem("not a statement")
            self.expect(";")

    def effect(self, start: int) -> bool:
        """Whether the expression may stand as a statement: an assignment, call, creation or step."""
        last = self.k[self.i - 1]
        if last in ("++", "--", ")", "}") or self.k[start] in ("++", "--", "new"):
            return True
        depth = 0
        for j in range(start, self.i):
            kind = self.k[j]
            depth += (kind in ("(", "[", "{")) - (kind in (")", "]", "}"))
            if depth == 0 and (kind in _ASSIGN or kind in (">", "<") and False):
                return True
            if depth == 0 and kind == ">" and self.k[j + 1] in (">=",):
                return True
        return False

    def condition(self) -> None:
        self.expect("(")
        self.expression()
        self.expect(")")

    def for_(self) -> None:
        self.i += 1
        self.expect("(")
        if self.k[self.i] != ";":
            if self.try_local():
                if self.accept(":"):
                    self.expression()
                    self.expect(")")
                    self.statement()
                    return
                self.declarators()
            else:
                self.expressions()
        self.expect(";")
        if self.k[self.i] != ";":
            self.expression()
        self.expect(";")
        if self.k[self.i] != ")":
            self.expressions()
        self.expect(")")
        self.statement()

    def expressions(self) -> None:
        self.expression()
        while self.accept(","):
            self.expression()

    def try_(self) -> None:
        self.i += 1
        handled = False
        if self.accept("("):
            handled = True
            while not self.accept(")"):
                if self.try_local():
                    self.expect("=")
                    self.expression()
                else:
                    self.expression()
                if self.k[self.i] != ")":
                    self.expect(";")
        self.block()
        while self.accept("catch"):
            handled = True
            self.expect("(")
            self.modifiers()
            self.type()
            while self.accept("|"):
                self.type()
            self.expect("NAME")
            self.expect(")")
            self.block()
        if self.accept("finally"):
            handled = True
            self.block()
        if not handled:
            raise self.fail("catch or finally")

    def switch(self) -> None:
        self.i += 1
        self.condition()
        self.expect("{")
        while not self.accept("}"):
            if self.accept("default"):
                pass
            else:
                self.expect("case")
                while True:
                    if not self.accept("default"):
                        start = self.i
                        if self.try_local() and self.k[self.i] in (":", "->", ",") or self.k[self.i] == "NAME":
                            pass
                        else:
                            self.i = start
                            self.pattern_or_value()
                    if not self.accept(","):
                        break
                if self.word("when"):
                    self.i += 1
                    self.conditional()
            if self.accept("->"):
                if self.k[self.i] == "{":
                    self.block()
                elif self.k[self.i] == "throw":
                    self.statement()
                else:
                    self.expression()
                    self.expect(";")
                continue
            self.expect(":")
            while self.k[self.i] not in ("case", "}") and not (self.k[self.i] == "default" and self.k[self.i + 1] in (":", "->")):
                if self.k[self.i] == "EOF":
                    raise self.fail("}")
                self.statement()

    def pattern_or_value(self) -> None:
        start = self.i
        try:
            self.pattern()
            if self.k[self.i] in (":", "->", ",") or self.word("when"):
                return
        except Problem:
            pass
        self.i = start
        self.conditional()

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.accept("("):
            while not self.accept(")"):
                self.pattern()
                if self.k[self.i] != ")":
                    self.expect(",")
            self.accept("NAME")
        else:
            self.expect("NAME")

    def lambda_head(self) -> bool:
        """Whether a lambda's parameters stand here: a name or parentheses with an arrow behind them."""
        k, i = self.k, self.i
        if k[i] == "NAME":
            return k[i + 1] == "->"
        depth = 0
        while k[i] != "EOF":
            depth += (k[i] == "(") - (k[i] == ")")
            i += 1
            if depth == 0:
                return k[i] == "->"
            if k[i] in (";", "{"):
                return False
        return False

    def expression(self) -> None:
        if self.k[self.i] in ("NAME", "(") and self.lambda_head():
            if self.k[self.i] == "NAME":
                self.i += 1
            elif self.k[self.i + 1] == "NAME" and self.k[self.i + 2] in (",", ")") or self.k[self.i + 1] == ")":
                self.i += 1
                while not self.accept(")"):
                    self.expect("NAME")
                    if self.k[self.i] != ")":
                        self.expect(",")
            else:
                self.parameters()
            self.expect("->")
            if self.k[self.i] == "{":
                self.block()
            else:
                self.expression()
            return
        self.conditional()
        k = self.k
        if k[self.i] in _ASSIGN:
            self.i += 1
            self.expression()
        elif k[self.i] == ">" and k[self.i + 1] == ">=" or k[self.i] == ">" and k[self.i + 1] == ">" and k[self.i + 2] == ">=":
            while k[self.i] != ">=":
                self.i += 1
            self.i += 1
            self.expression()

    def conditional(self) -> None:
        self.binary(0)
        if self.accept("?"):
            self.expression()
            self.expect(":")
            if self.k[self.i] in ("NAME", "(") and self.lambda_head():
                self.expression()
            else:
                self.conditional()

    def operator(self) -> tuple[str, int]:
        """The binary operator here and its tokens: shifts to the right come as single marks."""
        kind = self.k[self.i]
        if kind == ">" and self.k[self.i + 1] == ">" and self.p[self.i + 1] == self.p[self.i] + 1:
            if self.k[self.i + 2] == ">" and self.p[self.i + 2] == self.p[self.i] + 2:
                return ">>>", 3
            return ("", 0) if self.k[self.i + 2] == ">=" and self.p[self.i + 2] == self.p[self.i] + 2 else (">>", 2)
        if kind == ">" and self.k[self.i + 1] == ">=" and self.p[self.i + 1] == self.p[self.i] + 1:
            return "", 0
        return kind, 1

    def binary(self, least: int) -> None:
        self.unary()
        while True:
            kind, size = self.operator()
            power = _BINARY.get(kind)
            if power is None or power <= least:
                return
            self.i += size
            if kind == "instanceof":
                start = self.i
                try:
                    self.pattern()
                except Problem:
                    self.i = start
                    self.accept("final")
                    self.type()
            else:
                self.binary(power)

    def unary(self) -> None:
        while self.k[self.i] in ("+", "-", "++", "--", "!", "~"):
            self.i += 1
        if self.k[self.i] == "(" and self.cast():
            return
        self.primary()
        while self.k[self.i] in ("++", "--"):
            self.i += 1

    def cast(self) -> bool:
        start = self.i
        try:
            self.i += 1
            primitive = self.k[self.i] in _PRIMITIVE
            self.type()
            array = self.k[self.i - 1] == "]"
            while self.accept("&"):
                self.type()
            self.expect(")")
            nxt = self.k[self.i]
            if primitive and not array and nxt in ("+", "-", "++", "--") or nxt in ("NAME", "LIT", "(", "!", "~", "this", "super", "new", "true", "false", "null", "switch") or nxt in _PRIMITIVE:
                if nxt in ("NAME", "(") and self.lambda_head():
                    self.expression()
                else:
                    self.unary()
                return True
        except Problem:
            pass
        self.i = start
        return False

    def arguments(self) -> None:
        self.expect("(")
        if self.accept(")"):
            return
        while True:
            self.expression()
            if self.accept(")"):
                return
            self.expect(",")

    def primary(self) -> None:
        k = self.k
        kind = k[self.i]
        if kind in ("LIT", "this", "super", "true", "false", "null"):
            self.i += 1
        elif kind == "NAME":
            self.i += 1
            if k[self.i] == "<" or k[self.i] == "[" and k[self.i + 1] == "]":
                start = self.i
                try:  # a generic or array type before a method reference
                    self.type_arguments()
                    while self.accept("."):
                        self.expect("NAME")
                        self.type_arguments()
                    self.dimensions()
                    if k[self.i] != "::" and not (k[self.i] == "." and k[self.i + 1] == "class"):
                        raise Problem("no reference")
                except Problem:
                    self.i = start
        elif kind == "(":
            self.condition()
        elif kind == "new":
            self.creation()
        elif kind == "switch":
            self.switch()
        elif kind in _PRIMITIVE or kind == "void":
            self.i += 1
            self.dimensions()
            if k[self.i] not in (".", "::"):
                raise self.fail(".class")
        else:
            raise self.fail("expression")
        while True:
            kind = k[self.i]
            if kind == ".":
                self.i += 1
                self.type_arguments()
                if k[self.i] in ("NAME", "class", "this", "super"):
                    self.i += 1
                elif k[self.i] == "new":
                    self.creation()
                else:
                    raise self.fail("name")
            elif kind == "(":
                if k[self.i - 1] not in ("NAME", "this", "super"):
                    raise self.fail("operator")
                self.arguments()
            elif kind == "[":
                self.i += 1
                self.expression()
                self.expect("]")
            elif kind == "::":
                self.i += 1
                self.type_arguments()
                if k[self.i] not in ("NAME", "new"):
                    raise self.fail("method name")
                self.i += 1
            else:
                return

    def creation(self) -> None:
        self.i += 1
        while self.k[self.i] == "@":
            self.annotation()
        if self.k[self.i] in _PRIMITIVE:
            self.i += 1
        else:
            while True:
                self.expect("NAME")
                self.type_arguments()
                if not self.accept("."):
                    break
        if self.k[self.i] == "[":
            sized = False
            while self.accept("["):
                if self.accept("]"):
                    continue
                self.expression()
                self.expect("]")
                sized = True
            if not sized or self.k[self.i] == "{":
                if self.k[self.i] != "{":
                    raise self.fail("{")
                self.initializer()
            return
        self.arguments()
        if self.accept("{"):
            self.members()
