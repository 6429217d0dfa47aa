import ast
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repoloom.llm import syntax
from repoloom.llm.grammars import PARSERS

GOOD = {
    "js": [
        "", "#!/usr/bin/env node\n'use strict';\n", "const a = (b, {c, d = 1}, ...e) => ({x: 1, [y]: 2, z, get q() { return 1 }, async *m() { yield* f() }});", "let x = a / b / c, r = /[/]\\/(?<n>x)/gi.test(s);", "for (const [k, v] of Object.entries(o)) { if (k in v) continue; else break }",
        "class A extends B { static #p = 1; static { this.x = 2 } constructor() { super() } get y() { return this.#p } async *[Symbol.iterator]() {} }", "label: for (;;) { do { x++ } while (x < 3) break label }", "import a, { b as c } from 'm'; export default class {} export const d = 1; export { e } from './e';",
        "const t = `a ${b + `nested ${c}`} d`; tag`x`; a?.b?.[c]?.(d) ?? e; x ||= 1; y **= 2;", "async () => { await f(); for await (const x of y) {} }", "try { f() } catch { g() } finally { h() }", "var a\nvar b = function* () {}\n;[1].map(x => x)", "switch (x) { case 1: y(); default: z() }", "if (a) /re/.test(b)", "new Foo; new Foo.Bar(1).baz(); new.target; void 0; typeof x === 'u'", "({a, b} = c); [a, b] = [b, a];",
    ],
    "java": [
        "", "package a.b;\nimport static java.util.List.*;\n@A(x = 1, y = {2, 3}) public final class C<T extends D & E> extends F<T> implements G, H {\n  private final int[] a = {1, 2}, b[] = new int[3][];\n  static { f(); }\n  <U> C(int... x) throws IOException { this.<U>g(); }\n  abstract void m();\n}",
        "class A { void m() { List<Map<String, int[]>> x = new ArrayList<>(); x.forEach(y -> { }); Runnable r = () -> f(); Function<A, B> g = A::b; int z = (int) w + (String) v == null ? 1 : 2; for (var e : x) { } for (int i = 0, j = 1; i < 3; i++, j--) ; label: while (true) break label; } }",
        "enum E implements I { A(1) { void f() {} }, B; int x; E(int... v) {} }", "interface I { default int f() { return 1 >> 2 >>> 3; } int K = 1; }", "record P(int x, String y) implements Q { P { } }", "class S { int f(Object o) { return switch (o) { case Integer i when i > 0 -> i; case null, default -> { yield 0; } }; } boolean g(Object o) { return o instanceof String s && !s.isEmpty(); } }",
        'class T { String s = """\n  text "quoted"\n  """; char c = \'\\u0041\'; long l = 0xFFL + 1_000; double d = 1e3 + .5; { try (var r = open()) { } catch (A | B e) { throw e; } finally { } synchronized (this) { } assert x : "m"; } }', "@interface N { int value() default 1; }", "class U { int[] a() { return new int[] {1}; } Object b = new A() { int x; }; void c() { a[0] = b >>>= 2; ++x; new A(); } }",
    ],
    "sql": [
        "", "-- only (a comment", "CREATE TABLE IF NOT EXISTS a.b (id SERIAL PRIMARY KEY, n NUMERIC(10, 2) NOT NULL DEFAULT 0, t TIMESTAMP WITH TIME ZONE, CONSTRAINT c FOREIGN KEY (x, y) REFERENCES z (x, y) ON DELETE CASCADE, CHECK (n > 0), UNIQUE (n));", "INSERT INTO t (a, b) VALUES (1, 'it''s'), (NULL, -2) ON CONFLICT (a) DO UPDATE SET b = excluded.b RETURNING *;",
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r) SELECT DISTINCT a.*, count(*) FILTER (WHERE x) AS c, sum(y) OVER (PARTITION BY z ORDER BY w) FROM r AS a LEFT JOIN b USING (id), c WHERE a.x BETWEEN 1 AND 2 AND y NOT IN (1, 2) OR z IS NOT NULL AND w LIKE 'a%' GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC NULLS LAST LIMIT 3 OFFSET 1",
        "SELECT CASE WHEN a THEN 1 ELSE 2 END, CAST(x AS int), y::text[], EXISTS (SELECT 1), interval '1 day', extract(year FROM d) FROM f(1) g; UPDATE t SET a = 1, b = b + 1 WHERE id = 3; DELETE FROM t; DROP TABLE IF EXISTS t CASCADE; ALTER TABLE t ADD COLUMN c INT, DROP COLUMN d; CREATE UNIQUE INDEX i ON t (a DESC, lower(b)); BEGIN; COMMIT", "CREATE VIEW v AS SELECT 1; CREATE FUNCTION f() RETURNS int AS $$ BEGIN RETURN 1; END; $$ LANGUAGE plpgsql;",
        'CREATE TABLE a (s ENUM("x", "y") NOT NULL);', "CREATE INDEX i ON t USING btree (a text_pattern_ops DESC, b public.ops);", "SELECT * FROM [dbo].[x] WITH (NOLOCK) JOIN y WITH (INDEX(1)) ON x.a = y.a\nGO\nSELECT a\nFROM b\nGO 5\n", "SELECT a, count(*) FROM t GROUP BY GROUPING SETS ((a, b), (), CUBE (a)), ()",
        "DELIMITER //\nCREATE PROCEDURE p()\nBEGIN\n  SELECT 1;\n  SELECT 2;\nEND //\nDELIMITER ;\nSELECT 3;", "DELIMITER $$\nCREATE TRIGGER g BEFORE INSERT ON t FOR EACH ROW BEGIN SET NEW.a = 1; END$$\nDELIMITER ;\n", "COPY t (a, b) FROM stdin;\n1\tit's\n2\t((\n\\.\n\nSELECT 1;",
    ],
}
BAD = {
    "js": ["const a = ;", "function f( {", "return 1;", "if (a {", "let x = 'abc", "a b", "<<<<<<< HEAD\nx\n", "class A { x y }", "import re", "`a ${b", "const x;", "f(,)", "1 = a", "try { }", "({a b})", "/* open", "package demo;", "(a, b) => ", "()"],
    "java": ["class A {", "public class A { int x }", "class A { void f() { x + 1; } }", "class A { void f() { if (a { } }", "def f(): pass", "class A { String s = \"abc\n; }", "class { }", "class A { int f( { } }", "import a.b", "class A { void f() { return 1 } }", "<<<<<<< HEAD", "class A { void f() { a(1,); } }", "int x;", "class A { void f() { try { } } }"],
    "sql": ["CREATE TABLE a (id INT", "CREATE TABLE a (id INT,);", "INSERT INTO t (a, b VALUES (1)", "SELECT FROM;", "SELECT * FROM a WHERE", "SELECT a FROM b WHERE id >", "def f(): pass", "<<<<<<< HEAD", "CREATE TABLE a (id INT NOT)", "SELECT 'abc", "x", "INSERT INTO t VALUES (1,)", "SELECT a b c FROM d", "SELECT a FROM b\nGO\nSELECT FROM c\nGO", "DELIMITER //\nSELECT 1 FROM //\nDELIMITER ;", "COPY t FROM stdin;\n1\n\\.\nSELEC 1;", "SELECT a FROM b GROUP BY GROUPING SETS ((a)", "CREATE INDEX i ON t (a b c)"],
    "json": ["", "{", "[1,]", "{'a': 1}", '{"a": 1} x', '{"a" 1}', '["\n"]', "01", "nul", '{"a":1,}', "NaN"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in GOOD.items() for t in ts])
def test_good(language, text):
    assert syntax.check(language, text) == []


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in BAD.items() for t in ts])
def test_bad(language, text):
    assert syntax.check(language, text)


def test_own_sources_parse_and_every_error_is_kept():
    from pathlib import Path

    for f in Path("repoloom").rglob("*.py"):
        assert PARSERS["py"](f.read_text()) == [], f
    assert len(PARSERS["js"]("let = 1 2;\nf();\nlet x = ;\ng();\n")) >= 2


PIECES = st.sampled_from(["def f(x):\n", "    return x\n", "if a:\n", "  pass\n", "x = [1, 2\n", "]\n", "for i in y: z()\n", "class A:\n", "'s'\n", "try:\n", "except E:\n", "lambda: 1\n", "a = b = c, *d\n", "f(a=1, b)\n", "(yield)\n", "x: int = 3\n", "1 = a\n", "with a as b, c: pass\n", "\n", "# c\n", "async def g(*, k=1, **m): await h()\n", "f'{x!r:>{w}}'\n", "match x:\n", "  case [1, *_] | {'a': b}: pass\n", "print x\n", "del (a), b[0]\n", "@d\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=6))
def test_python_agrees_with_the_interpreter(pieces):
    text = "".join(pieces)
    try:
        ast.parse(text)
        valid = True
    except SyntaxError:
        valid = False
    assert (PARSERS["py"](text) == []) == valid


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[]",:0123eE+-.truefalsn \n\\u', max_size=25))
def test_json_agrees_with_the_library(text):
    try:
        json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
        valid = True
    except (ValueError, RecursionError):
        valid = False
    assert (PARSERS["json"](text) == []) == valid


def test_table(spark):
    rows = [(1, "p", "a.py", "def f(:\n"), (1, "p", "a.py", "def f(:\n"), (2, "p", "b.py", "x = 1\n"), (3, "p", "c.md", "def f(:"), (4, "p", None, "("), (5, None, "d.JS", "let"), (6, "p", "e.js", None), (7, "p", "f.sql", ""), (8, "p", "g.json", "[" * 50_000), (9, "p", "h.py", "(" * 5_000)]
    df = spark.createDataFrame(rows, "file_id bigint, project_id string, path string, content string").selectExpr("*", "'clash' as extension")
    assert {r.file_id for r in syntax.found(df).collect()} == {1, 8, 9}
    rates = {(r.project_id, r.language): (r.n_files, r.n_invalid) for r in syntax.rates(df).collect()}
    assert rates["p", "python"] == (3, 2) and rates["p", "json"] == (1, 1)
    assert syntax.found(df.limit(0)).count() == 0


def test_every_error_is_stored(spark):
    text = "<<<<<<< HEAD\nlet x = ;\nf();\nlet y = ;\n"
    rows = [(1, "p", "a.js", text), (2, "p", "b.js", "f();\n")]
    out = {r.file_id: r for r in syntax.errors(spark.createDataFrame(rows, "file_id bigint, project_id string, path string, content string")).collect()}
    assert [(e.at, e.message) for e in out[1].errors] == [(e.at, e.message) for e in syntax.check("js", text)]
    assert len(out[1].errors) == out[1].n_errors >= 2 and out[1].errors[0] == (out[1].first_at, out[1].first_cause) and out[2].errors == []


@pytest.mark.parametrize(
    ("language", "text"),
    [
        ("js", "if (a) {}" + " else if (a) { f() }" * 5000), ("js", "x = " + "(" * 5000 + "1" + ")" * 5000 + ";"), ("js", "x = " + "[" * 3000 + "]" * 3000 + ";"), ("java", "class A { void m() { if (a) { }" + " else if (a) { f(); }" * 5000 + " } }"),
        ("java", "class A { int x = " + "f(" * 2000 + "1" + ")" * 2000 + "; }"), ("sql", "SELECT " + "(" * 5000 + "1" + ")" * 5000), ("sql", "SELECT " + "CASE WHEN a THEN 1 ELSE " * 2000 + "1" + " END" * 2000),
    ],
)
def test_depth_does_not_decide_validity(language, text):
    import sys

    limit = sys.getrecursionlimit()
    assert syntax.check(language, text) == [] and sys.getrecursionlimit() == limit


def test_errors_behind_deep_nesting_are_found():
    deep = "x = " + "[" * 3000 + "]" * 3000 + ";\n"
    assert [e.at for e in syntax.check("js", deep + "let y = ;\n")] == [len(deep) + 8]
    assert syntax.check("js", "x = " + "(" * 30_000) and syntax.check("sql", "SELECT " + "(" * 30_000)
