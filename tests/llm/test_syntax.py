import ast
import json
from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import grammar, lexing, python_grammar, syntax

VALID = {
    "js": [
        "", "let a = 1\nlet b = a + 2\n", "for (const x of y) { f(x, ...z) }", "const {a, b: [c, d = 1], ...r} = o;", "x = a ? b : c => d;", "if (a) b; else if (c) { d } else e", "`a ${b + `c`} d`;",
        "class A extends B { #p = 1; static async *m(a, b = 2) { yield* a; } get x() { return this.#p } static { f() } }", "label: while (true) { break label }", "a?.b?.[c]?.(d) ?? e;", "var r = /[/]\\/x/g.test(s);",
        "export default async function () {}", "import a, {b as c} from './d';", "export * as ns from 'm';", "do { x++ } while (x < 3)", "switch (a) { case 1: f(); default: g() }", "try { a() } catch { b() } finally { c() }",
        "!function(e,t){var n=[1,,2];for(var i=0;i<3;i++)e.push(i);return n?n.a(1):!1}(this);", "const f = async (a) => { await a };", "// only a comment", "x = function () { return }\n(y)", "[a, b] = [b, a];", "({a} = b);", "new Foo;",
        "const a = `${x.map(y => { return { z: 1 }; })}`;", "if (x) /ab+c/.test(y);", "a = (b) / c / d;", "const b = `${f({a: {b: '}'}})} \\` ${`${g(`h`)}`}`; i();",
    ],
    "ts": [
        "function f<T extends object>(a: T, b?: number, ...c: string[]): Promise<Map<string, T[]>> { return g as any }", "interface A<T> extends B, C<T> { readonly a: string; m?(x: number): void; [k: string]: any }",
        "type U = 'a' | 1 | { b: string }[] | ((x: number) => void);", "enum E { A = 1, B, 'c' }", "abstract class A implements B { private constructor(public x: number, readonly y?: string) { super() } abstract m(): void; declare z: number }",
        "namespace N.M { export const a: number = 1 }", "declare module 'x' { export function f(a: string): void; }", "const x = <T,>(a: T) => a;", "let v = y!.z as const;", "function g(x: unknown): x is string { return true }", "type C<T> = T extends infer U ? U : never;",
        "import type { A } from './a';", "export abstract class Q {}", "let a: typeof b.c; let t: [a: string, b?: number];",
    ],
    "java": [
        "", "package a.b;\nimport java.util.*;\nimport static x.Y.z;\npublic final class A<T extends B & C> extends D<T> implements E, F { private static final int[] x = {1, 2}; A(int a) throws X { this(a, 2); } }",
        "class A { <T> void m(List<? extends T> a, int... b) { for (int i = 0, j = 1; i < 3; i++) { a.forEach(x -> { f(x); }); } } }", "enum E implements I { A(1) { void f() {} }, B; int x; }", "record R(int a, String b) { R { f(); } }",
        "interface I { default void f() {} int g(); }", "@Ann(value = {1, 2}) class A { @Override public String s() { return \"\"\"\n text \" \"\"\" + (String) x; } }", "class A { int f(Object o) { return switch (o) { case String s -> 1; default -> { yield 2; } }; } }",
        "class A { void f() { try (var r = g(); var q = h()) { } catch (X | Y e) { throw new Z(\"a\", e); } finally { } } }", "class A { Runnable r = A::new; int[][] m = new int[3][]; Supplier<List<String>> s = ArrayList<String>::new; }",
        "class A { void f() { a.b.<T>c(1)[2]++; int x = y > z ? 1 >> 2 : ~3; label: for (;;) { continue label; } synchronized (this) { assert a : b; } } }", "class A { { x = 1; } static { y = 2; } class B {} }",
    ],
    "go": [
        "package a\n", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\n\nconst (\n\tA = iota\n\tB\n)\n\nvar c, d int = 1, 2\n", "package a\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*C\n\td.E\n}\ntype I interface {\n\tM(a int) (b string, err error)\n\t~int | string\n}\n",
        "package a\nfunc (r *R) F(a, b int, c ...string) (int, error) {\n\tif x := f(); x > 0 {\n\t\treturn x, nil\n\t} else if y {\n\t}\n\tfor i := range c {\n\t\tcontinue\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor {\n\t}\n}\n",
        "package a\nfunc f() {\n\tswitch x := y.(type) {\n\tcase int, *T:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\t\tg(v)\n\tcase c <- 1:\n\t}\n\tdefer func() { recover() }()\n\tgo h()\n}\n",
        "package a\nvar m = map[string][]int{\n\t\"a\": {1, 2},\n\t\"b\": nil,\n}\nvar s = []struct{ a int }{{1}, {a: 2}}\n", "package a\nfunc G[T any, K comparable](x []T) T { return x[len(x)-1:][0] }\n", "package a\nfunc f() { a.b[1:2].c(x...).d = `raw {\n` }\n",
    ],
    "json": ['{"a": [1, -2.5e3, true, null, {}], "b": "\\u00e9\\n"}', "[]", '"x"', " 1 "],
    "py": ["", "x = 1\n", "def f(a, *, b: int = 2) -> None:\n\t'''doc'''\n\tpass\n", "match x:\n  case [1, *r]: pass\n  case _:\n    y\n", "if a: b\nelif c:\n    d\nelse: e\n", "try:\n  a\nexcept (B, C) as e:\n  pass\nelse:\n  b\nfinally:\n  c\n", "x = (1,\n  2)\n@d\nclass A(B): pass\n", "for i in x:\n  pass\nelse:\n  y\n", "s = f'{a!r:>{w}}' 'b' if 0 else '\\\n'\n", "async def f():\n  async with a as b: await c\n", "match = case = type = 1\nmatch(x)\n", "# c\n\n  # d\n"],
}
INVALID = {
    "js": ["let = = 1", "f(a, b", "x = 'open", "/* open", "`open", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n", "function (a) {}", "let a = 1 let b = 2", "return return", "if (a {", "}", "a + ;", "function f(a: number) {}", "def f():\n  pass\n", "<!DOCTYPE html><p>x</p>", "x = &quot;a&quot;;", "“a”", "for (let i = 0; i < 3) {}", "class A { f( { } }", "1 = 2;", "else x", "return 1", "break;", "const a = `${b;", "const a = `${{}`; f();"],
    "ts": ["let a: = 1;", "function f(a number) {}", "interface A { a: string b: number }", "enum E { A B }", "const x: number string = 1;"],
    "java": ["class A { void f() { x + y; } }", "class A { int x }", "class A { void f() { int x = 1 } }", "class { }", "void f() {}", "class A { void f( { } }", "package a import b;", "class A { void f() { if x { } } }", "class A {", "class A { for (;;) {} }"],
    "go": ["", "func f() {}", "package a\nfunc f() { if x = 1 { } }\n", "package a\nfunc f()\n{\n}\n", "package a\nvar x = f(1,\n2\n)\n", "package a\nfunc f() { a b }\n", "package a\nx := 1\n", "package a\nfunc f( {}\n", "package a\nfunc f() { for i := 0; i < 3 { } }\n"],
    "json": ["", "{a: 1}", "[1,]", '{"a": 1,}', "nul", '"\t"', "[1 2]", "NaN", "// c\n1", "[1]]", '{"a" 1}', "01"],
    "py": ["def f(:\n pass\n", "if a\n  b\n", "  x = 1\n", "x = (1\n", "def f():\nx\n", "else:\n  x\n", "try:\n  x\n", "@d\nx = 1\n", "x = 'a\n", "if a:\n    b\n  c\n", "match x:\n  y\n", "import\n", "a = 1 +\n", "“x”\n", "def f(): pass pass\n"],
}


@pytest.mark.parametrize(("lang", "text"), [(lang, t) for lang, texts in VALID.items() for t in texts])
def test_valid(lang, text):
    assert syntax.is_valid(text, lang)


@pytest.mark.parametrize(("lang", "text"), [(lang, t) for lang, texts in INVALID.items() for t in texts])
def test_invalid(lang, text):
    assert not syntax.is_valid(text, lang)


@pytest.mark.parametrize("text", VALID["py"] + INVALID["py"])
def test_python_shapes_accept_only_what_parses(text):
    tokens = lexing.tokenize("\n" + text, "py")
    if lexing.span_of(tokens, "py").balanced and python_grammar.fits(tokens):
        ast.parse(text)


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20), st.integers(0, 200), st.sampled_from(["", ",", "}", "1", '"', " "]))
def test_json_equals_the_library(value, at, junk):
    text = json.dumps(value, ensure_ascii=False)
    text = text[:at] + junk + text[at:] if at < len(text) else text
    try:
        json.loads(text)
        expected = True
    except ValueError:
        expected = False
    assert syntax.is_valid(text, "json") == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a {\n", "}\n", "(\n", ")\n", "'x'\n", "/* c\n", "c */\n", "`t\n", "t`\n", "// }\n", "[]\n"]), max_size=12))
def test_chunk_maps_are_associative_and_equal_the_whole(lines):
    pieces = lexing.chunks("".join(lines), 1)
    maps = [lexing.summarize(piece, "js") for piece in pieces]
    left = reduce(lexing.combine, maps)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = lexing.combine(m, right)
    assert left == right
    whole = lexing.span_of(lexing.tokenize("".join(lines), "js"), "js")
    assert left[lexing.CODE].balanced == whole.balanced
    assert lexing.file_span("".join(lines), "js", size=3).balanced == whole.balanced


BORDERS = {
    "js": ["x = `a\n\\`b ${f(`c\n${{d: 1}}`)}\n`;\nif (y) {\n/* } \n*/ z()\n}\n", "x = `\n${a\n+ `${\nb}`}\n`;\n", "f('a\\\nb')\n"],
    "java": ['class A { String s = """\n a \\""" b\n \\\\""";\n int x = 1; /*\n"""*/ }\n'],
    "go": ["package a\nvar x = `\n\\`\nvar y = 1\n"],
    "py": ["x = '''a\n\\''' b\n'''\nif x:\n    y = (1,\n  2)\n\n    # c\n    z = \\\n  3\nw\n", 'def f():\r\n    """a\r\n  """\r\n    return 1\r\n'],
    "json": ['{"a":\n[1,\n2]}\n'],
}


@pytest.mark.parametrize("size", [1, 2, 5, 9, 17, 1000])
@pytest.mark.parametrize(("lang", "text"), [(lang, t) for lang, texts in BORDERS.items() for t in texts])
def test_chunk_borders_do_not_change_tokens_or_verdicts(lang, text, size):
    def merged(tokens):
        """Line ends that follow one another are one, with the last one's indentation."""
        out = []
        for token in tokens:
            is_end = token[0] in "\n\r"
            if is_end and out and out[-1][0] in "\n\r":
                out.pop()
            out.append("\n" + token[max(token.rfind("\n"), token.rfind("\r")) + 1 :] if is_end else token)
        return out

    span, tokens = lexing.lex(text, lang, size)
    whole = lexing.tokenize(text, lang)
    assert span == lexing.span_of(whole, lang) and merged(tokens) == merged(whole)
    assert syntax.is_valid(text, lang, size) and "".join(lexing.chunks(text, size)) == text


@pytest.mark.parametrize(("lang", "text", "expected"), [(lang, t, True) for lang, ts in VALID.items() for t in ts] + [(lang, t, False) for lang, ts in INVALID.items() for t in ts])
def test_verdicts_in_small_chunks(lang, text, expected):
    assert syntax.is_valid(text, lang, 3) == expected


def test_deep_and_long_texts():
    assert syntax.is_valid("x = " + "(" * 3000 + "1" + ")" * 3000 + ";", "js")
    assert syntax.is_valid("[" * 20_000 + "]" * 20_000, "json")
    assert not syntax.is_valid("{" * 20_000, "java")
    assert syntax.is_valid("a;\n" * 200_000, "js") and lexing.file_span("f(\n" * 100_000 + ")\n" * 100_000, "ts").balanced


def test_tables_start_anew_between_texts(monkeypatch):
    monkeypatch.setattr(grammar, "_MOST_GROUPS", 3)
    js = grammar.JavaScript()
    for k in range(6):
        text = "f(" + ", ".join("ab"[:1] * 1 for _ in range(k + 1)) + "); x = {" + ", ".join(f"k{i}: [{i}]" for i in range(k)) + "};"
        assert js.valid_tokens(lexing.tokenize(text, "js"))
        assert len(js.bodies) <= 3 + 4
    monkeypatch.setattr(grammar, "_LAST_GROUP", grammar._FIRST_GROUP + 1)
    few = grammar.JavaScript()
    assert few.valid_tokens(lexing.tokenize("f(a); g(b, c); h(d, e, f); i(1); if (x) { y([1, 2], {z: [3]}) }", "js")) and few.class_bodies
    assert not few.valid_tokens(lexing.tokenize("f(a); g(b, c); h(d, e, f); i(1 2);", "js"))


def test_frame(spark):
    rows = [("r/a.py", "x = (", 1), ("r/b.py", None, 1), (None, "x", 1), ("r/c.txt", "(", 1), ("r/a.py", "x = (", 1), ("r/D.JSON", "{}", 1), ("q/e.go", "", 1)]
    frame = spark.createDataFrame(rows, "path string, content string, valid int")
    got = {(r.path, r.language, r.valid) for r in syntax.check_files(frame).collect()}
    assert got == {("r/a.py", "py", False), ("r/b.py", "py", None), (None, None, None), ("r/c.txt", "txt", None), ("r/D.JSON", "json", True), ("q/e.go", "go", False)}
    rates = {(r.repo, r.language): (r.n_files, r.n_invalid) for r in syntax.rates(syntax.check_files(frame)).collect()}
    assert rates == {("r", "py"): (2, 2), ("r", "json"): (1, 0), ("q", "go"): (1, 1)}
    assert syntax.check_files(frame.limit(0)).count() == 0


def test_chunk_rows(spark):
    rows = [("a.js", 0, "js", "f("), ("a.js", 1, "js", "\n/* )"), ("a.js", 2, "js", "\n*/ )\n"), ("b.js", 0, "js", "f(\n"), ("b.js", 1, "js", None)]
    got = {r.path: r.balanced for r in syntax.chunk_spans(spark.createDataFrame(rows, "path string, pos int, language string, chunk string")).collect()}
    assert got == {"a.js": True, "b.js": False}


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_chunk_maps_of_files_equal_the_whole(spark, size):
    texts = [(f"r/{k}.{lang}", t) for lang, ts in (VALID | {"x": ["("]}).items() for k, t in enumerate(ts)] + [(f"r/i{k}.{lang}", t) for lang, ts in INVALID.items() for k, t in enumerate(ts)] + [("r/n.js", None)]
    frame = spark.createDataFrame(texts, "path string, content string")
    got = {r.path: r.balanced for r in syntax.chunk_spans(syntax.chunk_rows(frame, size)).collect()}
    assert got == {p: lexing.file_span(t, p.rsplit(".", 1)[1]).balanced for p, t in texts if t is not None and not p.endswith(".x")}
