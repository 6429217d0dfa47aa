"""JavaScript (ECMAScript 2023), script or module."""

from __future__ import annotations

import re

from repoloom.llm.grammars.base import Error, Parser, Problem, any_depth

_SPACE = re.compile(r"(?:(?:[^\S\n\r\u2028\u2029]|\ufeff)+|\r\n|[\n\r\u2028\u2029]|//[^\n\r\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)+")
_NAME = re.compile(r"#?(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d+)?|\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d+)?n?)(?![\w$])")
_STRING = re.compile(r"\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-z]*(?![\w$])")
_MARK = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")

#: The commonest tokens, with blanks before them: a name of plain letters, or a mark that begins no longer one.
_COMMON = re.compile(r"[ \t]*(?:([A-Za-z_$][A-Za-z0-9_$]*+)(?![\w$\\\u200c\u200d])|([()\[\];,{]|\.(?![\d.])|=(?![=>])|:))")

#: Reserved words. Fixed values.
_KEYWORDS = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
_BEFORE_VALUE = frozenset("NAME NUM STR TPL RE ) ] } this super null true false".split())
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_PREFIX = frozenset("+ - ! ~ typeof void delete ++ --".split())
_STOPS = frozenset(";}")


@any_depth
def parse_javascript(text: str) -> list[Error]:
    """Errors of a script or module; of the two readings the one with fewer errors counts."""
    parser = _lex(text)
    parser.program()
    return sorted(parser.errors, key=lambda e: e.at)


def _lex(text: str) -> _Js:
    k: list[str] = []
    v: list[str] = []
    p: list[int] = []
    nl: list[bool] = []
    errors: list[Error] = []
    at, n = 0, len(text)
    if text.startswith("#!"):
        at = next((m.start() for m in re.finditer(r"[\n\r]", text)), n)
    line = True
    braces: list[bool] = []  # True where a brace closes a template's expression

    def put(kind: str, value: str, start: int) -> None:
        k.append(kind), v.append(value), p.append(start), nl.append(line)

    def template(start: int) -> int:
        m = _TEMPLATE.match(text, start)
        end = m.end()
        if end >= n:
            errors.append(Error(start - 1, "unterminated template"))
            return n
        if text[end] == "`":
            put("TPL", "`", start)
            return end + 1
        put("TPL{", "${", end)
        braces.append(True)
        return end + 2

    common, add_k, add_v, add_p, add_nl = _COMMON.match, k.append, v.append, p.append, nl.append
    while at < n:
        m = common(text, at)
        if m:
            value = m[1]
            if value:
                add_k(value if value in _KEYWORDS else "NAME"), add_v(value), add_p(m.start(1))
            else:
                value = m[2]
                if value == "{":
                    braces.append(False)
                add_k(value), add_v(value), add_p(m.start(2))
            add_nl(line)
            line = False
            at = m.end()
            continue
        m = _SPACE.match(text, at)
        if m:
            if not line and re.search(r"[\n\r\u2028\u2029]", m[0]):
                line = True
            at = m.end()
            continue
        c = text[at]
        if c == "/" and text.startswith("/*", at):
            errors.append(Error(at, "unterminated comment"))
            break
        if c.isdigit() or c == "." and at + 1 < n and text[at + 1].isdigit():
            m = _NUMBER.match(text, at)
            kind = "NUM"
        elif c in "\"'":
            m = _STRING.match(text, at)
            kind = "STR"
        elif c == "`":
            at = template(at + 1)
            line = False
            continue
        elif c == "/" and (not k or k[-1] not in _BEFORE_VALUE or k[-1] == ")" and _after_control(k) or k[-1] == "}" and line):
            m = _REGEX.match(text, at)
            kind = "RE"
            if m is None and k and k[-1] in ("}", ")"):
                m, kind = _MARK.match(text, at), "MARK"
        else:
            m = _NAME.match(text, at)
            kind = "NAME"
            if m is None:
                m, kind = _MARK.match(text, at), "MARK"
        if m is None:
            errors.append(Error(at, f"no token: {text[at : at + 20]!r}"))
            put("BAD", c, at)
            stop = re.compile(r"[\n\r]").search(text, at) if kind in ("STR", "RE") else None
            at = (stop.start() if stop else n) if kind in ("STR", "RE") else at + 1
            line = False
            continue
        value = m[0]
        if kind == "NAME" and value in _KEYWORDS:
            kind = value
        elif kind == "MARK":
            kind = value
            if value == "}" and braces and braces.pop():
                put("}TPL", "}", at)
                line = False
                at = template(at + 1)
                continue
        put(kind, value, at)
        line = False
        at = m.end()
    put("EOF", "", n)
    parser = _Js(k, v, p, errors)
    parser.nl = nl
    return parser


def _after_control(k: list[str]) -> bool:
    """Whether the last closing parenthesis ends the head of an ``if``, ``while``, ``for`` or ``with``."""
    depth = 0
    for j in range(len(k) - 1, -1, -1):
        if k[j] == ")":
            depth += 1
        elif k[j] == "(":
            depth -= 1
            if depth == 0:
                return j > 0 and k[j - 1] in ("if", "while", "for", "with")
    return False


class _Js(Parser):
    nl: list[bool]
    depth = 0

    def program(self) -> None:
        while self.k[self.i] != "EOF":
            start = self.i
            try:
                self.statement(True)
            except Problem as problem:
                self.note(problem)
                self.recover(_STOPS, start)

    def end(self) -> None:
        """The end of a statement: a semicolon, or one that may be inserted."""
        kind = self.k[self.i]
        if kind == ";":
            self.i += 1
        elif kind not in ("}", "EOF") and not self.nl[self.i]:
            raise self.fail(";")

    def word(self, text: str) -> bool:
        return self.k[self.i] == "NAME" and self.v[self.i] == text

    def block(self) -> None:
        self.expect("{")
        while self.k[self.i] != "}":
            if self.k[self.i] == "EOF":
                raise self.fail("}")
            self.statement()
        self.i += 1

    def statement(self, top: bool = False) -> None:
        kind = self.k[self.i]
        if kind == "{":
            self.block()
        elif kind == ";":
            self.i += 1
        elif kind in ("var", "const") or kind == "NAME" and self.v[self.i] == "let" and self.k[self.i + 1] in ("NAME", "{", "["):
            self.i += 1
            self.declarations(kind == "const", True)
            self.end()
        elif kind == "function" or kind == "NAME" and self.v[self.i] == "async" and self.k[self.i + 1] == "function" and not self.nl[self.i + 1]:
            self.function(True)
        elif kind == "class":
            self.klass(True)
        elif kind == "@":
            self.i += 1
            self.postfix()
        elif kind == "if":
            self.i += 1
            self.condition()
            self.statement()
            if self.accept("else"):
                self.statement()
        elif kind == "for":
            self.for_()
        elif kind in ("while", "with"):
            self.i += 1
            self.condition()
            self.statement()
        elif kind == "do":
            self.i += 1
            self.statement()
            self.expect("while")
            self.condition()
            self.accept(";")
        elif kind == "return" or kind == "throw":
            if kind == "return" and self.depth == 0:
                raise Problem("return outside of a function")
            self.i += 1
            if self.k[self.i] not in (";", "}", "EOF") and not self.nl[self.i]:
                self.expression()
            elif kind == "throw":
                raise self.fail("expression")
            self.end()
        elif kind in ("break", "continue"):
            self.i += 1
            if self.k[self.i] == "NAME" and not self.nl[self.i]:
                self.i += 1
            self.end()
        elif kind == "try":
            self.i += 1
            self.block()
            handled = False
            if self.accept("catch"):
                handled = True
                if self.accept("("):
                    self.pattern()
                    self.expect(")")
                self.block()
            if self.accept("finally"):
                handled = True
                self.block()
            if not handled:
                raise self.fail("catch or finally")
        elif kind == "switch":
            self.i += 1
            self.condition()
            self.expect("{")
            while not self.accept("}"):
                if self.accept("case"):
                    self.expression()
                else:
                    self.expect("default")
                self.expect(":")
                while self.k[self.i] not in ("case", "default", "}"):
                    if self.k[self.i] == "EOF":
                        raise self.fail("}")
                    self.statement()
        elif kind == "debugger":
            self.i += 1
            self.end()
        elif kind == "import" and self.k[self.i + 1] not in ("(", "."):
            self.import_()
        elif kind == "export":
            self.export()
        elif kind == "NAME" and self.k[self.i + 1] == ":":
            self.i += 2
            self.statement()
        else:
            self.expression()
            self.end()

    def condition(self) -> None:
        self.expect("(")
        self.expression()
        self.expect(")")

    def declarations(self, const: bool, require: bool, no_in: bool = False) -> None:
        while True:
            destructured = self.k[self.i] in ("{", "[")
            self.pattern()
            if self.accept("="):
                self.assignment(no_in)
            elif require and (const or destructured):
                raise self.fail("=")
            if not self.accept(","):
                return

    def pattern(self) -> None:
        kind = self.k[self.i]
        if kind == "NAME":
            self.i += 1
        elif kind == "[":
            self.i += 1
            while not self.accept("]"):
                if self.accept(","):
                    continue
                self.accept("...")
                self.element()
                if self.k[self.i] != "]":
                    self.expect(",")
        elif kind == "{":
            self.i += 1
            while not self.accept("}"):
                if self.accept("..."):
                    self.pattern()
                else:
                    named = self.k[self.i] == "NAME"
                    self.property_name()
                    if self.accept(":"):
                        self.element()
                    elif not named:
                        raise self.fail(":")
                    elif self.accept("="):
                        self.assignment()
                if self.k[self.i] != "}":
                    self.expect(",")
        else:
            raise self.fail("name or pattern")

    def element(self) -> None:
        self.pattern()
        if self.accept("="):
            self.assignment()

    def for_(self) -> None:
        self.i += 1
        if self.word("await"):
            self.i += 1
        self.expect("(")
        kind = self.k[self.i]
        if kind == ";":
            pass
        elif kind in ("var", "const") or self.word("let") and self.k[self.i + 1] in ("NAME", "{", "["):
            self.i += 1
            start = self.i
            self.declarations(False, False, True)
            if self.k[self.i] == ";" and self.k[start] in ("{", "["):
                pass
        else:
            self.expression(True)
        if self.accept("in"):
            self.expression()
        elif self.word("of"):
            self.i += 1
            self.assignment()
        else:
            self.expect(";")
            if self.k[self.i] != ";":
                self.expression()
            self.expect(";")
            if self.k[self.i] != ")":
                self.expression()
        self.expect(")")
        self.statement()

    def import_(self) -> None:
        self.i += 1
        if not self.accept("STR"):
            if self.k[self.i] == "NAME":
                self.i += 1
                if not self.accept(","):
                    self.from_()
                    return
            if self.accept("*"):
                if not self.word("as"):
                    raise self.fail("as")
                self.i += 1
                self.expect("NAME")
            else:
                self.names()
            self.from_()
            return
        self.end()

    def from_(self) -> None:
        if not self.word("from"):
            raise self.fail("from")
        self.i += 1
        self.expect("STR")
        if self.k[self.i] == "with" or self.word("assert"):
            self.i += 1
            self.object()
        self.end()

    def names(self) -> None:
        self.expect("{")
        while not self.accept("}"):
            for again in (True, False):
                if self.k[self.i] not in ("NAME", "STR") and self.k[self.i] not in _KEYWORDS:
                    raise self.fail("name")
                self.i += 1
                if not (again and self.word("as")):
                    break
                self.i += 1
            if self.k[self.i] != "}":
                self.expect(",")

    def export(self) -> None:
        self.i += 1
        if self.accept("default"):
            if self.k[self.i] == "function" or self.word("async") and self.k[self.i + 1] == "function":
                self.function(False)
            elif self.k[self.i] == "class":
                self.klass(False)
            else:
                self.assignment()
                self.end()
        elif self.accept("*"):
            if self.word("as"):
                self.i += 2
            self.from_()
        elif self.k[self.i] == "{":
            self.names()
            if self.word("from"):
                self.from_()
            else:
                self.end()
        elif self.k[self.i] in ("var", "const", "function", "class") or self.word("let") or self.word("async"):
            self.statement()
        else:
            raise self.fail("declaration")

    def function(self, named: bool) -> None:
        if self.word("async"):
            self.i += 1
        self.expect("function")
        self.accept("*")
        if self.k[self.i] == "NAME":
            self.i += 1
        elif named:
            raise self.fail("name")
        self.parameters()
        self.body()

    def parameters(self) -> None:
        self.expect("(")
        while not self.accept(")"):
            self.accept("...")
            self.element()
            if self.k[self.i] != ")":
                self.expect(",")

    def body(self) -> None:
        self.depth += 1
        try:
            self.block()
        finally:
            self.depth -= 1

    def klass(self, named: bool) -> None:
        self.i += 1
        if self.k[self.i] == "NAME":
            self.i += 1
        elif named:
            raise self.fail("name")
        if self.accept("extends"):
            self.postfix()
        self.expect("{")
        while not self.accept("}"):
            if not self.accept(";"):
                self.member()

    def member(self) -> None:
        while self.accept("@"):
            self.postfix()
        if self.word("static") and self.k[self.i + 1] not in ("(", "=", ";", "}"):
            self.i += 1
            if self.k[self.i] == "{":
                self.body()
                return
        for modifier in ("async", "get", "set", "accessor"):
            if self.word(modifier) and self.k[self.i + 1] not in ("(", "=", ";", "}") and not (self.nl[self.i + 1] and modifier != "get"):
                self.i += 1
                break
        self.accept("*")
        self.property_name()
        if self.k[self.i] == "(":
            self.parameters()
            self.body()
        else:
            if self.accept("="):
                self.depth += 1
                try:
                    self.assignment()
                finally:
                    self.depth -= 1
            self.end()

    def property_name(self) -> None:
        kind = self.k[self.i]
        if kind == "[":
            self.i += 1
            self.assignment()
            self.expect("]")
        elif kind in ("NAME", "STR", "NUM") or kind in _KEYWORDS:
            self.i += 1
        else:
            raise self.fail("property name")

    def expression(self, no_in: bool = False) -> None:
        self.assignment(no_in)
        while self.accept(","):
            self.assignment(no_in)

    def assignment(self, no_in: bool = False) -> None:
        k, i = self.k, self.i
        if k[i] == "NAME":
            v = self.v[i]
            if k[i + 1] == "=>" and not self.nl[i + 1]:
                self.i += 2
                self.arrow(no_in)
                return
            if v == "async" and k[i + 1] == "NAME" and k[i + 2] == "=>" and not self.nl[i + 1]:
                self.i += 3
                self.arrow(no_in)
                return
            if v == "yield" and self.depth:
                self.i += 1
                self.accept("*")
                if k[self.i] not in (")", "]", "}", ",", ";", ":", "EOF") and not self.nl[self.i]:
                    self.assignment(no_in)
                return
        self.conditional(no_in)
        if k[self.i] in _ASSIGN:
            if not self.target(i, self.i):
                raise Problem(f"{self.v[i][:30]!r} cannot be assigned to")
            self.i += 1
            self.assignment(no_in)

    def target(self, start: int, end: int) -> bool:
        """Whether the tokens can stand on the left of an assignment."""
        last = self.k[end - 1]
        if last in ("]", "}"):
            return True
        if last == "NAME" or last in _KEYWORDS and end - start > 1 and self.k[end - 2] in (".", "?."):
            return end - start == 1 or self.k[end - 2] in (".", "?.") or self.k[start] == "NAME" and self.v[start] in ("await", "yield")
        return last == ")" and self.k[start] == "("

    def arrow(self, no_in: bool) -> None:
        if self.k[self.i] == "{":
            self.body()
        else:
            self.depth += 1
            try:
                self.assignment(no_in)
            finally:
                self.depth -= 1

    def conditional(self, no_in: bool) -> None:
        self.binary(0, no_in)
        if self.accept("?"):
            self.assignment()
            self.expect(":")
            self.assignment(no_in)

    def binary(self, least: int, no_in: bool) -> None:
        self.unary()
        k = self.k
        while True:
            kind = k[self.i]
            power = _BINARY.get(kind)
            if power is None or power <= least or no_in and kind == "in":
                return
            self.i += 1
            self.binary(power - 1 if kind == "**" else power, no_in)

    def unary(self) -> None:
        while self.k[self.i] in _PREFIX or self.k[self.i] == "NAME" and self.v[self.i] == "await" and self.k[self.i + 1] not in (")", "]", "}", ",", ";", "=", ".", "EOF", "=>", ":") and not self.nl[self.i + 1]:
            self.i += 1
        self.postfix()
        if self.k[self.i] in ("++", "--") and not self.nl[self.i]:
            self.i += 1

    def postfix(self) -> None:
        start = self.i
        self.primary()
        k = self.k
        if k[self.i] == "=>" and k[self.i - 1] in (")", "}"):
            return
        while True:
            kind = k[self.i]
            if kind == ".":
                self.i += 1
                if k[self.i] != "NAME" and k[self.i] not in _KEYWORDS:
                    raise self.fail("property name")
                self.i += 1
            elif kind == "?.":
                self.i += 1
                if k[self.i] == "NAME" or k[self.i] in _KEYWORDS:
                    self.i += 1
                elif k[self.i] not in ("(", "["):
                    raise self.fail("property")
            elif kind == "[":
                self.i += 1
                self.expression()
                self.expect("]")
            elif kind == "(":
                arrow = self.v[start] == "async" and self.i == start + 1
                self.arguments()
                if arrow and k[self.i] == "=>" and not self.nl[self.i]:
                    self.i += 1
                    self.arrow(False)
                    return
            elif kind in ("TPL", "TPL{"):
                self.template()
            else:
                return

    def arguments(self) -> None:
        self.expect("(")
        while not self.accept(")"):
            self.accept("...")
            self.assignment()
            if self.k[self.i] != ")":
                self.expect(",")

    def template(self) -> None:
        while self.k[self.i] == "TPL{":
            self.i += 1
            self.expression()
            self.expect("}TPL")
        self.expect("TPL")

    def primary(self) -> None:
        kind = self.k[self.i]
        if kind in ("NAME", "NUM", "STR", "RE", "this", "null", "true", "false", "super"):
            if kind == "NAME" and self.v[self.i] == "async" and self.k[self.i + 1] == "function" and not self.nl[self.i + 1]:
                self.function(False)
                return
            self.i += 1
        elif kind == "(":
            self.i += 1
            rest = empty = comma = False
            if self.k[self.i] == ")":
                empty = True
            while self.k[self.i] != ")":
                if self.accept("..."):
                    rest = True
                    self.pattern()
                else:
                    self.assignment()
                comma = False
                if self.k[self.i] != ")":
                    self.expect(",")
                    comma = True
            self.i += 1
            if self.k[self.i] == "=>" and not self.nl[self.i]:
                self.i += 1
                self.arrow(False)
            elif rest or empty or comma:
                raise self.fail("=>")
        elif kind == "[":
            self.i += 1
            while not self.accept("]"):
                if self.accept(","):
                    continue
                self.accept("...")
                self.assignment()
                if self.k[self.i] != "]":
                    self.expect(",")
        elif kind == "{":
            self.object()
        elif kind == "function":
            self.function(False)
        elif kind == "class":
            self.klass(False)
        elif kind in ("TPL", "TPL{"):
            self.template()
        elif kind == "new":
            self.i += 1
            if self.accept("."):
                self.expect("NAME")
                return
            self.primary()
            while self.k[self.i] in (".", "["):
                if self.accept("."):
                    self.i += 1
                else:
                    self.i += 1
                    self.expression()
                    self.expect("]")
            if self.k[self.i] == "(":
                self.arguments()
        elif kind == "import":
            self.i += 1
            if self.accept("."):
                self.expect("NAME")
            else:
                self.arguments()
        else:
            raise self.fail("expression")

    def object(self) -> None:
        self.expect("{")
        while not self.accept("}"):
            if self.accept("..."):
                self.assignment()
            else:
                named = self.k[self.i] == "NAME"
                for modifier in ("async", "get", "set"):
                    if self.word(modifier) and self.k[self.i + 1] not in ("(", ":", ",", "}", "="):
                        self.i += 1
                        named = False
                        break
                if self.accept("*"):
                    named = False
                self.property_name()
                if self.k[self.i] == "(":
                    self.parameters()
                    self.body()
                elif self.accept(":"):
                    self.assignment()
                elif not named:
                    raise self.fail(":")
                elif self.accept("="):
                    self.assignment()
            if self.k[self.i] != "}":
                self.expect(",")
