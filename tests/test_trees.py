import pytest

from lodestrata.operators import trees

FILES = [
    ("r/a.py", "python", "import os, sys\nfrom . import x\n\n@dec\nclass A(B):\n    async def m(self, a, *, b=1):\n        return f(a, key=b)\n\n\ndef g(): pass\n"),
    ("r/bad.py", "python", "def f(:\n"), ("r/none.py", "python", None), ("r/x.txt", "unknown", "class A"),
    ("r/a.js", "javascript", "// class No {\nclass A extends B {\n  // {\n  m(a = {x: '}'}) { if (a) { return new C(a) } }\n  static async n() { }\n}\nconst f = (x) => {\n  return `${x}}`;\n};\nfunction g() { function h() { } }\nfoo(function k() { });\n"),
    ("r/a.ts", "typescript", "export interface I { a: string }\nenum E { A }\nnamespace N { export class C<T> { get<K>(k: K): Map<string, K> { return null; } } }\n"),
    ("r/A.java", "java", "package a;\npublic class A {\n  A(int x) { this.x = x; }\n  public <T> List<T> get(T t) throws E, F { return new L() { void no() { } }; }\n  interface I { }\n}\n"),
    ("r/a.go", "go", "package a\n\nimport (\n\t\"x\"\n)\n\ntype T struct {\n\ta int\n}\n\nfunc (t *T) M(a int) (int, error) {\n\tif a > 0 {\n\t}\n}\n\nfunc F(\n\ta int,\n) {\n}\n"),
    ("r/open.js", "javascript", "function f() {\n  a(\n"), ("r/empty.js", "javascript", ""),
]


@pytest.fixture(scope="module")
def tree(spark):
    return trees.nodes(spark.createDataFrame(FILES, "path string, language string, content string")).cache()


def test_symbols(tree):
    got = {(r.path, r.name, r.kind, r.start_line, r.end_line, r.parent) for r in trees.symbols(tree).collect()}
    assert got == {
        ("r/a.py", "A", "class", 5, 7, None), ("r/a.py", "m", "method", 6, 7, "A"), ("r/a.py", "g", "function", 10, 10, None),
        ("r/a.js", "A", "class", 2, 6, None), ("r/a.js", "m", "method", 4, 4, "A"), ("r/a.js", "n", "method", 5, 5, "A"), ("r/a.js", "f", "function", 7, 9, None), ("r/a.js", "g", "function", 10, 10, None), ("r/a.js", "h", "function", 10, 10, "g"),
        ("r/a.ts", "I", "interface", 1, 1, None), ("r/a.ts", "E", "enum", 2, 2, None), ("r/a.ts", "N", "namespace", 3, 3, None), ("r/a.ts", "C", "class", 3, 3, "N"), ("r/a.ts", "get", "method", 3, 3, "C"),
        ("r/A.java", "A", "class", 2, 6, None), ("r/A.java", "A", "constructor", 3, 3, "A"), ("r/A.java", "get", "method", 4, 4, "A"), ("r/A.java", "I", "interface", 5, 5, "A"),
        ("r/a.go", "T", "struct", 7, 9, None), ("r/a.go", "M", "method", 11, 14, None), ("r/a.go", "F", "function", 16, 19, None), ("r/open.js", "f", "function", 1, 2, None),
    }


def test_diagnostics(tree):
    assert {(r.path, r.line) for r in trees.diagnostics(tree).collect()} == {("r/bad.py", 1), ("r/open.js", 2)}


def test_parameters(tree):
    assert {(r.function, r.place, r.name) for r in trees.parameters(tree).collect()} == {("m", 1, "self"), ("m", 2, "a"), ("m", 3, "b")}


def test_queries(tree):
    run = lambda name, lang, q: {(r.pattern, r.text, r.line_start) for r in trees.match(tree, name, lang, q).collect()}
    known = {(n, lang): q for n, lang, q in trees.QUERIES}
    assert run("import", "python", known["import", "python"]) == {("import:import", None, 1), ("import:module", "os", 1), ("import:module", "sys", 1), ("import:from_import", None, 2), ("import:module", ".", 2)}
    assert run("a", "python", known["async_function", "python"]) == {("a:async_keyword", "async", 6), ("a:name", "m", 6), ("a:async_func", None, 6)}
    assert run("d", "python", known["decorator", "python"]) == {("d:decorator_name", "dec", 4), ("d:decorator", None, 4)}
    assert run("c", "python", "(class_definition name: (identifier) @name superclasses: (identifier)? @_base (function_definition (missing)? @x)) @class") == {("c:name", "A", 5), ("c:class", None, 5)}
    assert run("k", "python", "(call (keyword) @key)") == {("k:key", "key", 7)} and run("any", "python", "(_ (keyword) @key)") == {("any:key", "key", 7)}
    assert {r.pattern for r in trees.search(tree, "CLASS").collect()} == {"class_def:class", "class_def:name"} and trees.search(tree, "nothing like it").count() == 0


@pytest.mark.parametrize("query", ["", "x", "(a", "(a) b", "(a (b)", "[(a)"])
def test_broken_queries_are_refused(query):
    with pytest.raises((ValueError, IndexError)):
        trees.parse_query(query)


def test_empty(spark):
    none = trees.nodes(spark.createDataFrame([], "path string, language string, content string"))
    assert none.count() == 0 and trees.symbols(none).count() == 0 and trees.parameters(none).count() == 0
