import pytest

from lodestrata.llm import functions as fn

CASES = {
    "js": (
        "// a\n// b\nexport async function foo(a, b = {x: 1}) {\n  if (a) { return 1 }\n}\n\n/** doc */\nconst bar = (x) => {\n  return x;\n};\nclass A {\n  // one\n  m1(a) { // no\n    for (;;) { }\n  }\n\n"
        "  static async m2() {\n  }\n  get x() { return {a: 1}; }\n}\nfoo(); // not this\nfunction last() {\n}\n",
        [("foo", 3, 3, 5, "// a\n// b"), ("bar", 8, 8, 10, "/** doc */"), ("m1", 13, 13, 15, "// one"), ("m2", 17, 17, 18, None), ("x", 19, 19, 19, None), ("last", 22, 22, 23, None)],
    ),
    "java": (
        "package a;\n/** c */\npublic class A {\n  /**\n   * doc\n   */\n  @Override\n  @A(x = {1})\n  public Map<String, List<X>> size(int a, B b) throws X, Y {\n    return new C() { void run() { } };\n  }\n  // k\n  A() { }\n"
        "  public double record(int a) { return 1; }\n  record Point(int x) { }\n}\n",
        [("run", 10, 10, 10, None), ("size", 7, 9, 11, "/**\n   * doc\n   */"), ("A", 13, 13, 13, "// k"), ("record", 14, 14, 14, None)],
    ),
    "go": ("package a\n\n// Size does.\n// more\nfunc (r *T) Size(a int) (int, error) {\n\treturn 1, nil\n}\nfunc x() interface{} {\n}\n", [("Size", 5, 5, 7, "// Size does.\n// more"), ("x", 8, 8, 9, None)]),
    "ts": (
        "/** d */\nfunction f(a: number): { x: number } {\n  return {x: 1};\n}\nexport class B<T> {\n  /** e */\n  protected get<K>(k: K, o: {a: string}): Map<string, K> {\n    return null;\n  }\n}\n",
        [("f", 2, 2, 4, "/** d */"), ("get", 7, 7, 9, "/** e */")],
    ),
    "py": (
        "import x\n@a\n@b(1)\ndef f(a,\n      b):\n    \'doc\'\n    def g():\n        return 1\n    return g\n\nclass A:\n    async def m(self):\n        \"m doc\"\n        x = [\n1]\n\n    y = 1\ns = \'\'\'\ndef no(): pass\n\'\'\'\n",
        [("g", 7, 7, 8, None), ("f", 2, 4, 9, "\'doc\'"), ("m", 12, 12, 15, "\"m doc\"")],
    ),
    "json": ("{}", []),
}


@pytest.mark.parametrize("lang", sorted(CASES))
def test_functions(lang):
    text, expected = CASES[lang]
    found, valid = fn.functions_of(text, lang)
    assert valid and [(f.name, f.first, f.line, f.last, f.doc) for f in found] == expected
    # Line ends of any kind count alike.
    crlf = fn.functions_of(text.replace("\n", "\r\n"), lang)[0]
    assert [(f.name, f.first, f.line, f.last) for f in crlf] == [e[:4] for e in expected]


@pytest.mark.parametrize(
    ("lang", "text", "names"),
    [
        ("js", "// a\nfunction one() {\n  return 1;\n}\nfunction two() {\n  if (x) {\n    y();\n// c\nfunction three() {\n  return 3;\n}\n<<<<<<< HEAD\nfunction four() { return 4; }\n=======\nfunction four() { return 5; }\n>>>>>>> b\nfunction five() {\n  return (1;\n}\nfunction six() {\n", ["one", "three", "four", "four"]),
        ("js", "function a() {\n  let x = = 1;\n}\nfunction b() {\n  return 1;\n}\n", ["b"]), ("java", "class A {\n  int a() { return 1; }\n  int b() { return }\n  int c() { int 1x; }\n", ["a"]), ("go", "package p\nfunc a() {\n\tx := 1\n}\nfunc b( {\n}\n", ["a"]),
        ("py", "def a(:\n  \'lost\'\n\n}}}\n<<<<<<< HEAD\n@x\ndef b(c):\n  \'found\'\n  return 1\ndef c(x, (:\n  pass\ndef d():\n  return (1\n", ["b"]), ("py", "class A:\n    def a(self):\n        return 1\n    def b(self)\n        return 2\n    def c(self):\n        re", ["a", "c"]), ("ts", "}}}}", []), ("js", "", []),
    ],
)
def test_whole_functions_of_broken_files(lang, text, names):
    assert [f.name for f in fn.functions_of(text, lang)[0]] == names


def test_long_and_deep_texts():
    many = "".join(f"// doc {i}\nfunction f{i}(a) {{\n  return a;\n}}\n" for i in range(20_000))
    found, valid = fn.functions_of(many, "js", check=False)
    assert len(found) == 20_000 and found[-1].doc == "// doc 19999" and found[-1].line == 79_998
    deep = "{" * 5_000 + "}" * 4_000
    assert fn.functions_of(deep, "go", check=False)[0] == [] and fn.functions_of("(" * 3_000, "java", check=False)[0] == []


def test_extract(spark):
    rows = [("r/a.js", "// d\nfunction f() {\n}\n", "k"), ("r/a.js", None, "k"), ("r/b.PY", "def g():\n  pass\n", "k"), ("r/c.txt", "def g():\n  pass\n", "k"), (None, "x", "k"), ("r/d.js", "function f() {\n}\n}", "k")]
    out = {tuple(r) for r in fn.extract(spark.createDataFrame(rows, "path string, content string, code string")).collect()}
    assert out == {("r/a.js", "f", 2, 2, 3, "// d", "function f() {\n}", False), ("r/b.PY", "g", 1, 1, 2, None, "def g():\n  pass", False), ("r/d.js", "f", 1, 1, 2, None, "function f() {\n}", True)}
    assert fn.extract(spark.createDataFrame([], "path string, content string")).count() == 0
