"""SQL: the common core of the widespread dialects. Statements of rarer kinds are only checked for balance."""

from __future__ import annotations

import re

from repoloom.llm.grammars.base import Error, Parser, Problem, any_depth

_TOKEN = re.compile(
    r"(?P<space>(?:\s+|--[^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/)+)"
    r"|(?P<str>[nNeExXbB]?'(?:[^']|'')*'|\$(?P<tag>\w*)\$[\s\S]*?\$(?P=tag)\$)"
    r"|(?P<quoted>\"(?:[^\"]|\"\")*\"|`[^`]*`|\[[A-Za-z_][^\]\n]*\])"
    r"|(?P<num>(?:0[xX][0-9a-fA-F]+|(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)(?!\w))"
    r"|(?P<name>[^\W\d][\w$#]*|[@:#$][\w$#]+|@@\w+)"
    r"|(?P<mark><=>|->>|#>>|::|:=|<>|!=|<=|>=|\|\||->|#>|<<|>>|&&|[-+*/%^&|~<>=(),;.:?\[\]{}!@#])"
)
#: Lines that clients read themselves, and the rows behind ``COPY ... FROM STDIN``.
_COMMAND = re.compile(r"(?i)(?:DELIMITER[ \t]+(?P<delimiter>\S+)|GO(?:[ \t]+\d+)?)[ \t]*;?[ \t]*(?=[\r\n]|\Z)")
_COPY_DATA = re.compile(r"[ \t]*(?:\r\n|\n|\r)(?:(?!\\\.[ \t]*(?:[\r\n]|\Z))[^\r\n]*(?:\r\n|\n|\r))*\\\.[ \t]*(?=[\r\n]|\Z)")
#: Words that begin a statement, and words that cannot be a name without quotes. Fixed values.
_BEGIN = frozenset("SELECT INSERT UPDATE DELETE CREATE ALTER DROP WITH VALUES TRUNCATE GRANT REVOKE BEGIN COMMIT ROLLBACK START SET USE PRAGMA EXPLAIN ANALYZE VACUUM COMMENT CALL EXECUTE EXEC DECLARE MERGE REPLACE SAVEPOINT RELEASE LOCK UNLOCK COPY SHOW DESCRIBE DESC REINDEX ATTACH DETACH DO END RENAME IF GO PREPARE DEALLOCATE REFRESH TABLE CLUSTER LISTEN NOTIFY RESET DISCARD FETCH CLOSE OPEN PRINT RETURN WHILE LOAD IMPORT".split())
_RESERVED = frozenset("SELECT FROM WHERE GROUP HAVING ORDER LIMIT UNION INTERSECT EXCEPT INSERT INTO UPDATE DELETE CREATE DROP ALTER TABLE JOIN ON AND OR NOT IN IS NULL LIKE BETWEEN CASE WHEN THEN ELSE END AS DISTINCT VALUES SET EXISTS PRIMARY FOREIGN REFERENCES CHECK CONSTRAINT UNIQUE DEFAULT USING INNER CROSS NATURAL WITH".split())
_BINARY = {"OR": 1, "AND": 2, "=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "<>": 4, "!=": 4, "<=>": 4, "||": 5, "->": 5, "->>": 5, "#>": 5, "#>>": 5, "&": 5, "|": 5, "#": 5, "<<": 5, ">>": 5, "&&": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7, "^": 8, "AT": 8, "COLLATE": 9}
_STOPS = frozenset(";")


@any_depth
def parse_sql(text: str) -> list[Error]:
    """Errors of a script; statements are separated by semicolons, the last one may go without."""
    k: list[str] = []
    v: list[str] = []
    p: list[int] = []
    errors: list[Error] = []
    at, n = 1 if text.startswith("\ufeff") else 0, len(text)
    delimiter, first = ";", 0  # where the current statement begins in ``k``
    while at < n:
        if delimiter != ";" and text.startswith(delimiter, at):
            k.append(";"), v.append(delimiter), p.append(at)
            at, first = at + len(delimiter), len(k)
            continue
        m = _TOKEN.match(text, at)
        if m is None:
            errors.append(Error(at, f"no token: {text[at : at + 20]!r}"))
            if text.startswith("/*", at) or text[at] in "'\"`":
                break
            at += 1
            continue
        kind = m.lastgroup if m.lastgroup != "tag" else "str"
        if kind == "name" and (command := _COMMAND.match(text, at)) and (at == 0 or text[:at].rstrip(" \t")[-1:] in ("", "\n", "\r")):
            if command["delimiter"]:
                delimiter = command["delimiter"]
            else:  # the end of a batch
                k.append(";"), v.append(command[0]), p.append(at)
            at, first = command.end(), len(k)
            continue
        end = m.end()
        if kind != "space":
            value = m[0]
            if kind == "name" and delimiter != ";" and (cut := value.find(delimiter)) > 0:
                value, end = value[:cut], at + cut
            k.append(value if kind == "mark" else value.upper() if kind == "name" else "QUOTED" if kind == "quoted" else "STR" if kind == "str" else "NUM")
            v.append(value), p.append(at)
            if value == ";" and delimiter == ";":
                if k[first] == "COPY" and "STDIN" in k[first:] and (data := _COPY_DATA.match(text, m.end())):
                    at, first = data.end(), len(k)
                    continue
                first = len(k)
        at = end
    for _ in range(4):
        k.append("EOF"), v.append(""), p.append(n)
    parser = _Sql(k, v, p, errors)
    parser.script()
    return sorted(parser.errors, key=lambda e: e.at)


class _Sql(Parser):
    def script(self) -> None:
        while self.k[self.i] != "EOF":
            if self.accept(";"):
                continue
            start = self.i
            try:
                self.statement()
                if self.k[self.i] not in (";", "EOF", "GO"):
                    raise self.fail(";")
            except Problem as problem:
                self.note(problem)
                self.recover(_STOPS, start)

    def is_name(self, kind: str) -> bool:
        return kind == "QUOTED" or (kind[:1].isalpha() or kind[:1] in "_@:#$") and len(kind) > 0 and kind not in _RESERVED and kind not in ("EOF", "STR", "NUM") and (kind[:1].isalpha() or kind[:1] == "_" or len(kind) > 1)

    def name(self) -> None:
        if not self.is_name(self.k[self.i]):
            raise self.fail("name")
        self.i += 1

    def qualified(self) -> None:
        self.name()
        while self.accept("."):
            if self.accept("*"):
                return
            self.i += 1 if self.k[self.i] in _RESERVED else 0
            if self.k[self.i - 1] == ".":
                self.name()

    def names(self) -> None:
        self.expect("(")
        while True:
            self.expression()
            if self.k[self.i] not in ("ASC", "DESC", "NULLS") and self.is_name(self.k[self.i]):
                self.qualified()  # an operator class
            self.accept("ASC")
            self.accept("DESC")
            if self.accept("NULLS"):
                self.i += 1
            if self.accept(")"):
                return
            self.expect(",")

    def rest(self) -> None:
        """The rest of a statement of a rarer kind: balanced up to the semicolon."""
        depth, block = 0, 0
        body = any(x in ("FUNCTION", "PROCEDURE", "TRIGGER") for x in self.k[max(0, self.i - 6) : self.i + 2])
        while self.k[self.i] != "EOF":
            kind = self.k[self.i]
            if kind == "(":
                depth += 1
            elif kind == ")":
                depth -= 1
                if depth < 0:
                    raise self.fail("no )")
            elif body and kind in ("BEGIN", "CASE"):
                block += 1
            elif body and kind == "END" and self.k[self.i + 1] not in ("IF", "LOOP", "WHILE"):
                block -= 1
            elif kind == ";" and depth == 0 and block <= 0:
                return
            self.i += 1
        if depth or block > 0:
            raise self.fail(") or END")

    def statement(self) -> None:
        kind = self.k[self.i]
        if kind in ("SELECT", "WITH", "VALUES", "("):
            self.query()
        elif kind in ("INSERT", "REPLACE"):
            self.insert()
        elif kind == "UPDATE":
            self.i += 1
            if self.accept("OR"):
                self.i += 1
            self.accept("ONLY")
            self.qualified()
            self.alias()
            self.expect("SET")
            while True:
                if self.k[self.i] == "(":
                    self.names()
                else:
                    self.qualified()
                self.expect("=")
                if not self.accept("DEFAULT"):
                    self.expression()
                if not self.accept(","):
                    break
            if self.accept("FROM"):
                self.tables()
            self.where()
            self.returning()
        elif kind == "DELETE":
            self.i += 1
            self.expect("FROM")
            self.accept("ONLY")
            self.qualified()
            self.alias()
            if self.accept("USING"):
                self.tables()
            self.where()
            self.returning()
        elif kind == "CREATE":
            self.create()
        elif kind == "ALTER":
            self.alter()
        elif kind == "DROP":
            self.i += 1
            self.kind_of_object()
            if self.accept("IF"):
                self.expect("EXISTS")
            self.qualified()
            while self.accept(","):
                self.qualified()
            if self.k[self.i] == "(" or self.k[self.i] == "ON":
                self.rest()
            if self.k[self.i] in ("CASCADE", "RESTRICT"):
                self.i += 1
        elif kind == "EXPLAIN":
            self.i += 1
            while self.k[self.i] in ("ANALYZE", "VERBOSE", "QUERY", "PLAN"):
                self.i += 1
            self.statement()
        elif kind in _BEGIN:
            self.i += 1
            self.rest()
        else:
            raise self.fail("statement")

    def kind_of_object(self) -> None:
        for word in ("MATERIALIZED", "TEMPORARY", "TEMP", "FOREIGN", "UNIQUE"):
            self.accept(word)
        if self.k[self.i] not in ("TABLE", "VIEW", "INDEX", "SCHEMA", "DATABASE", "SEQUENCE", "TRIGGER", "FUNCTION", "PROCEDURE", "TYPE", "USER", "ROLE", "EXTENSION", "DOMAIN", "COLUMN", "CONSTRAINT", "POLICY", "RULE", "SYNONYM", "AGGREGATE", "EVENT"):
            raise self.fail("kind of object")
        self.i += 1
        self.accept("CONCURRENTLY")

    def insert(self) -> None:
        self.i += 1
        if self.accept("OR"):
            self.i += 1
        self.accept("IGNORE")
        if not self.accept("OVERWRITE"):
            self.expect("INTO")
        self.accept("TABLE")
        self.qualified()
        if self.accept("AS"):
            self.name()
        if self.k[self.i] == "(" and self.k[self.i + 1] not in ("SELECT", "WITH"):
            self.names()
        if self.accept("DEFAULT"):
            self.expect("VALUES")
        elif self.accept("SET"):
            self.rest()
        else:
            if self.accept("OVERRIDING"):
                self.i += 2
            self.query()
        if self.accept("ON"):
            if self.accept("DUPLICATE"):
                self.rest()
            else:
                self.expect("CONFLICT")
                if self.k[self.i] == "(":
                    self.names()
                    self.where()
                elif self.accept("ON"):
                    self.expect("CONSTRAINT")
                    self.name()
                self.expect("DO")
                if not self.accept("NOTHING"):
                    self.expect("UPDATE")
                    self.expect("SET")
                    while True:
                        self.qualified()
                        self.expect("=")
                        self.expression()
                        if not self.accept(","):
                            break
                    self.where()
        self.returning()

    def returning(self) -> None:
        if self.accept("RETURNING"):
            self.columns()

    def where(self) -> None:
        if self.accept("WHERE"):
            self.expression()

    def create(self) -> None:
        self.i += 1
        if self.accept("OR"):
            self.expect("REPLACE")
        for word in ("GLOBAL", "LOCAL", "TEMPORARY", "TEMP", "UNLOGGED", "EXTERNAL", "RECURSIVE", "MATERIALIZED"):
            self.accept(word)
        if self.accept("TABLE"):
            self.if_not_exists()
            self.qualified()
            if self.accept("AS"):
                self.query()
            elif self.accept("LIKE"):
                self.qualified()
            else:
                if self.k[self.i] == "PARTITION":
                    self.rest()
                    return
                self.table_body()
                if self.accept("AS"):
                    self.query()
                elif self.k[self.i] not in (";", "EOF"):
                    self.options()
        elif self.k[self.i] == "VIEW":
            self.i += 1
            self.if_not_exists()
            self.qualified()
            if self.k[self.i] == "(":
                self.names()
            self.expect("AS")
            self.query()
            if self.accept("WITH"):
                self.rest()
        elif self.k[self.i] in ("UNIQUE", "INDEX", "CLUSTERED", "NONCLUSTERED", "FULLTEXT", "SPATIAL"):
            while not self.accept("INDEX"):
                if self.k[self.i] not in ("UNIQUE", "CLUSTERED", "NONCLUSTERED", "FULLTEXT", "SPATIAL"):
                    raise self.fail("INDEX")
                self.i += 1
            self.accept("CONCURRENTLY")
            self.if_not_exists()
            if self.k[self.i] != "ON":
                self.qualified()
            self.expect("ON")
            self.accept("ONLY")
            self.qualified()
            if self.accept("USING"):
                self.name()
            self.names()
            if self.k[self.i] in ("INCLUDE", "WITH", "TABLESPACE", "USING", "COMMENT"):
                while self.k[self.i] not in (";", "EOF", "WHERE"):
                    self.i += 1
            self.where()
        elif self.k[self.i] in ("FUNCTION", "PROCEDURE", "TRIGGER", "SCHEMA", "DATABASE", "SEQUENCE", "TYPE", "USER", "ROLE", "EXTENSION", "DOMAIN", "POLICY", "RULE", "VIRTUAL", "AGGREGATE", "EVENT", "SERVER", "FOREIGN", "LOGIN", "CONSTRAINT", "DEFINER", "STATISTICS", "CAST", "OPERATOR", "PUBLICATION", "SUBSCRIPTION", "COLLATION", "LANGUAGE", "SYNONYM", "PACKAGE", "TABLESPACE"):
            self.rest_named()
        else:
            raise self.fail("kind of object")

    def rest_named(self) -> None:
        self.i += 1
        if self.k[self.i] in (";", "EOF"):
            raise self.fail("name")
        self.rest()

    def options(self) -> None:
        if self.k[self.i] not in ("ENGINE", "WITH", "WITHOUT", "STRICT", "COMMENT", "CHARSET", "DEFAULT", "CHARACTER", "COLLATE", "AUTO_INCREMENT", "PARTITION", "PARTITIONED", "TABLESPACE", "INHERITS", "ON", "STORED", "LOCATION", "ROW_FORMAT", "USING", "CLUSTERED", "TBLPROPERTIES", "ROW"):
            raise self.fail(";")
        self.rest()

    def if_not_exists(self) -> None:
        if self.accept("IF"):
            self.expect("NOT")
            self.expect("EXISTS")

    def table_body(self) -> None:
        self.expect("(")
        while True:
            self.column_or_constraint()
            if self.accept(")"):
                return
            self.expect(",")

    def column_or_constraint(self) -> None:
        if self.accept("CONSTRAINT"):
            self.name()
        kind = self.k[self.i]
        if kind == "PRIMARY":
            self.i += 1
            self.expect("KEY")
            self.names()
        elif kind == "UNIQUE" and self.k[self.i + 1] in ("(", "KEY", "INDEX"):
            self.i += 1
            if self.k[self.i] != "(":
                self.i += 1
                if self.k[self.i] != "(":
                    self.name()
            self.names()
        elif kind == "FOREIGN":
            self.i += 1
            self.expect("KEY")
            if self.k[self.i] != "(":
                self.name()
            self.names()
            self.references()
        elif kind == "CHECK":
            self.i += 1
            self.parenthesised()
        elif kind in ("KEY", "INDEX") and (self.k[self.i + 1] == "(" or self.k[self.i + 2] == "("):
            self.i += 1
            if self.k[self.i] != "(":
                self.name()
            self.names()
        elif kind == "LIKE":
            self.i += 1
            self.qualified()
        elif kind == "EXCLUDE":
            while self.k[self.i] != "(":
                self.i += 1
            self.balanced()
        else:
            self.column()
            return
        while self.k[self.i] in ("ON", "DEFERRABLE", "NOT", "INITIALLY", "MATCH", "USING", "ENFORCED"):
            self.constraint()

    def parenthesised(self) -> None:
        self.expect("(")
        self.expression()
        self.expect(")")

    def balanced(self) -> None:
        self.expect("(")
        depth = 1
        while depth:
            if self.k[self.i] in ("EOF", ";"):
                raise self.fail(")")
            depth += (self.k[self.i] == "(") - (self.k[self.i] == ")")
            self.i += 1

    def references(self) -> None:
        self.expect("REFERENCES")
        self.qualified()
        if self.k[self.i] == "(":
            self.names()

    def column(self) -> None:
        if self.k[self.i] not in ("PRIMARY", "CHECK", "FOREIGN") and self.k[self.i] in _RESERVED:
            raise self.fail("column")
        self.name()
        if self.is_name(self.k[self.i]):
            self.type()
        while self.constraint():
            pass

    def type(self) -> None:
        self.qualified()
        words = 0
        while self.k[self.i] in ("PRECISION", "VARYING", "UNSIGNED", "SIGNED", "ZEROFILL", "CHARACTER", "LARGE", "OBJECT", "BYTE", "CHAR", "VARCHAR", "INT", "BINARY", "LOCAL") and words < 4:
            self.i += 1
            words += 1
        if self.accept("("):
            while not self.accept(")"):
                if self.k[self.i] not in ("NUM", "STR", "QUOTED", "MAX", ",", "CHAR", "BYTE", "*", "-"):
                    raise self.fail("size")
                self.i += 1
        while self.k[self.i] in ("UNSIGNED", "SIGNED", "ZEROFILL", "VARYING"):
            self.i += 1
        if self.k[self.i] in ("WITH", "WITHOUT") and self.k[self.i + 1] in ("TIME", "LOCAL"):
            self.i += 1
            self.accept("LOCAL")
            self.expect("TIME")
            self.expect("ZONE")
        while self.accept("["):
            self.accept("NUM")
            self.expect("]")
        self.accept("ARRAY")

    def constraint(self) -> bool:
        kind = self.k[self.i]
        if kind == "CONSTRAINT":
            self.i += 1
            self.name()
            return True
        if kind == "NOT":
            self.i += 1
            if self.k[self.i] not in ("NULL", "DEFERRABLE", "ENFORCED", "VALID"):
                raise self.fail("NULL")
            self.i += 1
        elif kind in ("NULL", "AUTO_INCREMENT", "AUTOINCREMENT", "UNIQUE", "DEFERRABLE", "ENFORCED", "VISIBLE", "INVISIBLE", "STORED", "VIRTUAL", "PERSISTED", "ROWGUIDCOL", "SPARSE", "FIRST", "ASC", "DESC"):
            self.i += 1
            if kind == "UNIQUE":
                self.accept("KEY")
        elif kind == "PRIMARY":
            self.i += 1
            self.expect("KEY")
        elif kind == "KEY":
            self.i += 1
        elif kind == "DEFAULT":
            self.i += 1
            self.binary(3)
        elif kind == "CHECK":
            self.i += 1
            self.parenthesised()
        elif kind == "REFERENCES":
            self.references()
        elif kind == "ON":
            self.i += 1
            if self.k[self.i] not in ("DELETE", "UPDATE", "CONFLICT"):
                raise self.fail("DELETE or UPDATE")
            self.i += 1
            if self.k[self.i] in ("SET", "NO"):
                self.i += 2
            elif self.k[self.i] in ("CASCADE", "RESTRICT", "IGNORE", "REPLACE", "ABORT", "FAIL", "ROLLBACK"):
                self.i += 1
            else:
                self.expression()
        elif kind == "INITIALLY":
            self.i += 2
        elif kind == "COLLATE":
            self.i += 1
            self.qualified()
        elif kind in ("COMMENT", "AFTER", "MATCH", "USING"):
            self.i += 1
            self.i += 1
        elif kind in ("CHARACTER", "CHARSET"):
            self.i += 1
            self.accept("SET")
            self.name()
        elif kind in ("GENERATED", "IDENTITY", "AS"):
            self.i += 1
            if kind == "GENERATED":
                while self.k[self.i] in ("ALWAYS", "BY", "DEFAULT", "ON", "NULL"):
                    self.i += 1
                self.expect("AS")
            self.accept("IDENTITY")
            if self.k[self.i] == "(":
                self.balanced()
        else:
            return False
        return True

    def alter(self) -> None:
        self.i += 1
        if self.k[self.i] != "TABLE":
            self.kind_of_object()
            self.rest()
            return
        self.i += 1
        if self.accept("IF"):
            self.expect("EXISTS")
        self.accept("ONLY")
        self.qualified()
        while True:
            kind = self.k[self.i]
            if kind == "ADD":
                self.i += 1
                if self.k[self.i] in ("CONSTRAINT", "PRIMARY", "FOREIGN", "CHECK", "UNIQUE", "INDEX", "KEY"):
                    self.column_or_constraint()
                else:
                    self.accept("COLUMN")
                    self.if_not_exists()
                    if self.k[self.i] == "(":
                        self.table_body()
                    else:
                        self.column()
            elif kind in ("DROP", "RENAME", "ALTER", "MODIFY", "CHANGE", "SET", "OWNER", "ENABLE", "DISABLE", "ATTACH", "DETACH", "VALIDATE", "CLUSTER", "RESET", "CONVERT", "ENGINE", "INHERIT", "REPLICA"):
                self.i += 1
                if self.k[self.i] in (";", "EOF"):
                    raise self.fail("action")
                depth = 0
                while self.k[self.i] not in (";", "EOF") and not (depth == 0 and self.k[self.i] == ","):
                    depth += (self.k[self.i] == "(") - (self.k[self.i] == ")")
                    self.i += 1
                if depth:
                    raise self.fail(")")
            else:
                raise self.fail("action")
            if not self.accept(","):
                return

    def query(self) -> None:
        if self.accept("WITH"):
            self.accept("RECURSIVE")
            while True:
                self.name()
                if self.k[self.i] == "(":
                    self.names()
                self.expect("AS")
                if self.accept("NOT"):
                    pass
                self.accept("MATERIALIZED")
                self.expect("(")
                self.statement()
                self.expect(")")
                if not self.accept(","):
                    break
            if self.k[self.i] in ("INSERT", "UPDATE", "DELETE", "MERGE"):
                self.statement()
                return
        self.operand()
        while self.k[self.i] in ("UNION", "INTERSECT", "EXCEPT", "MINUS"):
            self.i += 1
            if not self.accept("ALL"):
                self.accept("DISTINCT")
            self.operand()
        self.order_and_limit()

    def order_and_limit(self) -> None:
        if self.k[self.i] == "ORDER":
            self.order()
        while self.k[self.i] in ("LIMIT", "OFFSET", "FETCH", "FOR"):
            kind = self.k[self.i]
            self.i += 1
            if kind == "FETCH":
                self.i += 1
                if self.k[self.i] not in ("ROW", "ROWS"):
                    self.expression()
                self.i += 1
                if not self.accept("ONLY"):
                    self.expect("WITH")
                    self.i += 1
            elif kind == "FOR":
                self.i += 1
                while self.k[self.i] in ("UPDATE", "OF", "NOWAIT", "SKIP", "LOCKED"):
                    self.i += 1
            else:
                if not self.accept("ALL"):
                    self.expression()
                if self.k[self.i] in ("ROW", "ROWS"):
                    self.i += 1
                if self.accept(","):
                    self.expression()

    def order(self) -> None:
        self.expect("ORDER")
        self.expect("BY")
        while True:
            self.expression()
            if not self.accept("ASC"):
                self.accept("DESC")
            if self.accept("NULLS"):
                self.i += 1
            if not self.accept(","):
                return

    def operand(self) -> None:
        if self.accept("("):
            self.query()
            self.expect(")")
            return
        if self.accept("VALUES"):
            while True:
                self.expect("(")
                while True:
                    if not self.accept("DEFAULT"):
                        self.expression()
                    if self.accept(")"):
                        break
                    self.expect(",")
                if not self.accept(","):
                    return
        if self.accept("TABLE"):
            self.qualified()
            return
        self.expect("SELECT")
        if not self.accept("ALL") and self.accept("DISTINCT") and self.accept("ON"):
            self.names()
        if self.accept("TOP"):
            self.accept("(")
            self.expect("NUM")
            self.accept(")")
        self.columns()
        if self.accept("INTO"):
            self.qualified()
        if self.accept("FROM"):
            self.tables()
        self.where()
        if self.accept("GROUP"):
            self.expect("BY")
            self.accept("ALL")
            if self.k[self.i] not in (";", "EOF", "HAVING", "ORDER", ")"):
                self.grouping()
                while self.accept(","):
                    self.grouping()
        if self.accept("HAVING"):
            self.expression()
        if self.accept("QUALIFY"):
            self.expression()
        if self.accept("WINDOW"):
            while True:
                self.name()
                self.expect("AS")
                self.balanced()
                if not self.accept(","):
                    break

    def grouping(self) -> None:
        if self.k[self.i] == "GROUPING" and self.k[self.i + 1] == "SETS":
            self.i += 2
            self.expect("(")
            while True:
                self.grouping()
                if self.accept(")"):
                    return
                self.expect(",")
        elif self.k[self.i] == "(" and self.k[self.i + 1] == ")":
            self.i += 2
        else:
            self.expression()

    def columns(self) -> None:
        while True:
            if not self.accept("*"):
                self.expression()
                if self.accept("AS"):
                    self.i += 1 if self.k[self.i] == "STR" else 0
                    if self.k[self.i - 1] == "AS":
                        self.name()
                elif self.is_name(self.k[self.i]) and self.k[self.i] not in ("INTO", "FROM", "OFFSET", "FETCH", "WINDOW", "QUALIFY", "FOR", "MINUS", "RETURNING"):
                    self.i += 1
            if not self.accept(","):
                return

    def alias(self) -> None:
        if self.accept("AS"):
            self.name()
        elif self.is_name(self.k[self.i]) and self.k[self.i] not in ("LEFT", "RIGHT", "FULL", "OUTER", "OFFSET", "FETCH", "WINDOW", "QUALIFY", "FOR", "MINUS", "RETURNING", "LATERAL", "TABLESAMPLE", "ASOF", "SEMI", "ANTI", "DO"):
            self.i += 1
        else:
            return
        if self.k[self.i] == "(":
            self.names()

    def tables(self) -> None:
        self.table()
        while True:
            if self.accept(","):
                self.table()
                continue
            start = self.i
            while self.k[self.i] in ("NATURAL", "INNER", "CROSS", "LEFT", "RIGHT", "FULL", "OUTER", "ASOF", "SEMI", "ANTI"):
                self.i += 1
            if self.k[self.i] != "JOIN":
                if self.i > start:
                    raise self.fail("JOIN")
                return
            self.i += 1
            self.table()
            if self.accept("ON"):
                self.expression()
            elif self.accept("USING"):
                self.names()

    def table(self) -> None:
        self.accept("LATERAL")
        self.accept("ONLY")
        if self.accept("("):
            if self.k[self.i] in ("SELECT", "WITH", "VALUES", "("):
                self.query()
            else:
                self.tables()
            self.expect(")")
        else:
            self.qualified()
            if self.k[self.i] == "(":
                self.call()
        self.alias()
        if self.k[self.i] == "WITH" and self.k[self.i + 1] == "(":  # table hints
            self.i += 1
            self.balanced()
        if self.accept("TABLESAMPLE"):
            self.name()
            self.balanced()

    def expression(self) -> None:
        self.binary(0)

    def binary(self, least: int) -> None:
        if self.k[self.i] == "NOT" and least < 4:
            self.i += 1
            self.binary(3)
        else:
            self.unary()
        while True:
            kind = self.k[self.i]
            if kind in ("IS", "IN", "LIKE", "ILIKE", "BETWEEN", "NOT", "SIMILAR", "REGEXP", "RLIKE", "GLOB", "ISNULL", "NOTNULL", "~", "!"):
                if least >= 4:
                    return
                if kind == "NOT" and self.k[self.i + 1] not in ("IN", "LIKE", "ILIKE", "BETWEEN", "SIMILAR", "REGEXP", "RLIKE", "GLOB"):
                    return
                self.predicate()
                continue
            power = _BINARY.get(kind)
            if power is None or power <= least:
                return
            self.i += 1
            if kind == "AT":
                self.expect("TIME")
                self.expect("ZONE")
            if kind == "COLLATE":
                self.qualified()
                continue
            if self.k[self.i] in ("ANY", "ALL", "SOME") and self.k[self.i + 1] == "(":
                self.i += 1
            self.binary(power)

    def predicate(self) -> None:
        kind = self.k[self.i]
        self.i += 1
        if kind == "IS":
            self.accept("NOT")
            if self.accept("DISTINCT"):
                self.expect("FROM")
                self.binary(4)
            elif self.k[self.i] in ("NULL", "TRUE", "FALSE", "UNKNOWN"):
                self.i += 1
            else:
                self.unary()
            return
        if kind == "NOT":
            kind = self.k[self.i]
            self.i += 1
        if kind == "!":
            self.expect("~")
            kind = "~"
        if kind == "~":
            self.accept("*")
        if kind in ("ISNULL", "NOTNULL"):
            return
        if kind == "IN":
            if self.accept("("):
                if self.k[self.i] in ("SELECT", "WITH", "VALUES"):
                    self.query()
                else:
                    self.expression()
                    while self.accept(","):
                        self.expression()
                self.expect(")")
            else:
                self.unary()
        elif kind == "BETWEEN":
            self.accept("SYMMETRIC")
            self.binary(4)
            self.expect("AND")
            self.binary(4)
        else:
            if kind == "SIMILAR":
                self.expect("TO")
            self.binary(4)
            if self.accept("ESCAPE"):
                self.unary()

    def unary(self) -> None:
        while self.k[self.i] in ("-", "+", "~", "@"):
            self.i += 1
        self.primary()
        while True:
            if self.accept("::"):
                self.type()
            elif self.k[self.i] == "[":
                self.i += 1
                if self.k[self.i] != ":":
                    self.expression()
                if self.accept(":") and self.k[self.i] != "]":
                    self.expression()
                self.expect("]")
            elif self.k[self.i] == "." and self.k[self.i - 1] in (")", "]"):
                self.i += 1
                self.name()
            else:
                return

    def primary(self) -> None:
        kind = self.k[self.i]
        if kind in ("NUM", "NULL", "DEFAULT", "?"):
            self.i += 1
        elif kind == "STR":
            while self.accept("STR"):
                pass
        elif kind == "(":
            self.i += 1
            if self.k[self.i] in ("SELECT", "WITH", "VALUES"):
                self.query()
            else:
                self.expression()
                while self.accept(","):
                    self.expression()
            self.expect(")")
        elif kind == "CASE":
            self.i += 1
            if self.k[self.i] != "WHEN":
                self.expression()
            if self.k[self.i] != "WHEN":
                raise self.fail("WHEN")
            while self.accept("WHEN"):
                self.expression()
                self.expect("THEN")
                self.expression()
            if self.accept("ELSE"):
                self.expression()
            self.expect("END")
        elif kind == "EXISTS":
            self.i += 1
            self.expect("(")
            self.query()
            self.expect(")")
        elif kind == "CAST" or kind == "TRY_CAST":
            self.i += 1
            self.expect("(")
            self.expression()
            self.expect("AS")
            self.type()
            self.expect(")")
        elif kind in ("ARRAY", "ROW", "STRUCT", "MAP") and self.k[self.i + 1] in ("[", "{"):
            self.i += 1
            self.bracket()
        elif kind in ("[", "{"):
            self.bracket()
        elif kind in ("DATE", "TIME", "TIMESTAMP", "INTERVAL") and self.k[self.i + 1] in ("STR", "NUM"):
            self.i += 2
            if self.k[self.i] in ("DAY", "MONTH", "YEAR", "HOUR", "MINUTE", "SECOND", "WEEK"):
                self.i += 1
        elif kind in ("LEFT", "RIGHT", "REPLACE", "IF", "VALUES", "SET") and self.k[self.i + 1] == "(" or self.is_name(kind):
            if kind in _RESERVED:
                self.i += 1
            else:
                self.qualified()
            if self.k[self.i] == "(":
                self.call()
        else:
            raise self.fail("expression")

    def bracket(self) -> None:
        close = {"[": "]", "{": "}"}[self.k[self.i]]
        self.i += 1
        while not self.accept(close):
            self.expression()
            if self.accept(":"):
                self.expression()
            if self.k[self.i] != close:
                self.expect(",")

    def call(self) -> None:
        self.expect("(")
        if not self.accept("*"):
            self.accept("DISTINCT")
            while self.k[self.i] != ")":
                if self.k[self.i] in ("SELECT", "WITH"):
                    self.query()
                else:
                    self.expression()
                if self.k[self.i] in ("FROM", "FOR", "AS", "IN", "USING", "SEPARATOR"):
                    self.i += 1
                    continue
                if self.k[self.i] == "ORDER":
                    self.order()
                    continue
                if self.k[self.i] != ")":
                    self.expect(",")
                    if self.k[self.i] == ")":
                        raise self.fail("argument")
        self.expect(")")
        if self.accept("FILTER"):
            self.expect("(")
            self.where()
            self.expect(")")
        if self.accept("WITHIN"):
            self.expect("GROUP")
            self.balanced()
        if self.accept("OVER"):
            if self.k[self.i] == "(":
                self.balanced()
            else:
                self.name()
