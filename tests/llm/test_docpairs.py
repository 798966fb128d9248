import pytest

from lodestrata.llm import docpairs as dp
from lodestrata.llm.gll import Parse


def test_gll_handles_ambiguity_and_left_recursion():
    grammar = {"E": (("E", "+", "E"), ("n",))}
    parse = Parse(grammar, "n+n+n", "E")
    assert parse.ends["E", 0] == {1, 3, 5}
    assert Parse({"A": ((), ("a", "A", "b"))}, "aabb", "A").ends["A", 0] == {0, 2, 4} or 4 in Parse({"A": ((), ("a", "A", "b"))}, "aabb", "A").ends["A", 0]
    assert Parse({"A": (("A", "a"), ("a",))}, "aaa", "A").ends["A", 0] == {1, 2, 3}


@pytest.mark.parametrize(
    ("lines", "expected"),
    [
        (["// a", "// b", "F"], "// a\n// b"), (["/** a */", "F"], "/** a */"), (["/**", " * a", " */", "F"], "/**\n * a\n */"), (["/*", "x", "*/", "@A(1)", "@B", "F"], "/*\nx\n*/"), (["// a", "", "F"], None),
        (["x();", "F"], None), (["F"], None), (["// old", "/** a */", "F"], "/** a */"), (["x = 1; /* c */", "F"], None), (["/* a", "b */", "// c", "F"], "// c"), ([" */", "F"], None),
    ],
)
def test_comment_above(lines, expected):
    assert dp.comment_above(lines, len(lines) - 1) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('def f():\n    """Doc."""\n', '"""Doc."""'), ("def f(a: int = {'b': [1]}, *c) -> d[e]:\n\n  # x\n  r'''Doc\n  more'''\n", "r'''Doc\n  more'''"), ('async def f(): "one"; x\n', '"one"'), ("def f():\n    x = 'no'\n", None), ("def f():\n    f'no'\n", None),
        ("def f():\n    b'no'\n", None), ("def f(:\n    'broken'\n", None), ("def f(\n  a,  # (\n  b):\n  'yes'\n", "'yes'"), ("def f():", None), ("class A:\n  'no'\n", None),
    ],
)
def test_string_in_body(text, expected):
    assert dp.string_in_body(text, 0) == expected


def test_functions_come_out_of_broken_files():
    broken = "def a(:\n  '''lost'''\n\n}}}\n<<<<<<< HEAD\n@x\ndef b(c):\n  '''found'''\n"
    assert dp.attached(broken, "py", [1, 6, 7, 99, 0]) == [(1, None), (6, "'''found'''"), (7, "'''found'''"), (99, None), (0, None)]
    assert dp.attached("((((\r\n/** doc */\r\nfunction f() {\r\n", "js", [3]) == [(3, "/** doc */")]


NAME, SIGNATURE = "load_cache_entry", "def load_cache_entry(self, key: str, limit: int) -> bytes"


@pytest.mark.parametrize(
    "doc",
    [
        "", "   ", '""""""', "/** */", "...", "-----", "/***/", "TODO", "FIXME: later", "tbd.", "N/A", "n/a", "None", "docs: coming soon", "Beschreibung folgt.", "No description available.", "Insert description here", "undocumented", "XXX", "?",
        "noqa", "# pylint: disable=missing-docstring", "// eslint-disable-next-line", "@ts-ignore", "type: ignore", "{@inheritDoc}", "Auto-generated method stub", "Generated stub, please document.", "nolint", "to be documented", "comment",
        "load_cache_entry", "Load cache entry.", "Loads the cache entry", "Function load_cache_entry", "loadCacheEntry()", "This loads a cache entry.", "Load cache entry!\n\nArgs:\nReturns:", "Load cache entry.\n\n:param value:\n:returns:",
        "@param key @param limit @return", ":param key:\n:return:", "/**\n * @param key\n * @param limit\n * @return\n */", SIGNATURE, "def load_cache_entry(self, key, limit)", "Keys.", "self, key, limit",
    ],
)
def test_trivial(doc):
    assert dp.telling_text(doc, dp.own_words(NAME, SIGNATURE)) == ""


@pytest.mark.parametrize(
    "doc",
    [
        "Not thread-safe!", "Never returns null.", "Mutates its input.", "O(1) after warm-up.", "Caller closes the handle.", "Result is kept for a minute.", "TODO: split this.\nReads whole blocks at once.", "Load cache entry.\n\nFails when the disk is full.",
        "@param key the oldest one to start from", ":param limit: at most so many bytes", "Summary\n=======\nDrops old rows.", "Ne modifie jamais l'original.", "状態を返す", "Documentation is read from the server.",
    ],
)
def test_informative(doc):
    assert dp.telling_text(doc, dp.own_words(NAME, SIGNATURE)) != ""


FUNCTIONS = "id long, name string, signature string, context string, doc string, template string"


def test_judge(spark):
    filler = "TODO-list: someone has to write the documentation of this step before the next release."
    rows = [(i, f"f{i}", None, None, filler, "t") for i in range(6)] + [(10, None, None, None, "Keeps order.", "t"), (11, "g", None, None, None, "t"), (12, "", "", "", "", "t"), (10, None, None, None, "Keeps order.", "t"), (13, "h", None, None, "Sorts. " * 50_000, "t")]
    out = dp.judge(spark.createDataFrame(rows, FUNCTIONS))
    assert sorted(r.id for r in out.where("informative").collect()) == [10, 10, 13] and out.count() == len(rows)
    assert dp.judge(spark.createDataFrame([], FUNCTIONS)).count() == 0


def test_attached_comments(spark):
    contents = spark.createDataFrame([("a.js", "// d\nfunction f() {\n}\n", 1), ("b.js", None, 1), ("c.py", "def g():\n  'x'\n", 1)], "path string, content string, line int")
    asked = spark.createDataFrame([("a.js", 2), ("a.js", 2), ("a.js", 77), ("a.js", None), ("b.js", 1), ("zz.js", 1), ("c.py", 1), (None, 1)], "path string, line int")
    assert {tuple(r) for r in dp.attached_comments(asked, contents).collect()} == {("a.js", 2, "// d"), ("c.py", 1, "'x'")}


@pytest.mark.parametrize(
    ("name", "doc"),
    [("annotate", "Add comments to the document."), ("items", "TODO list of the user, newest first."), ("roi", "Region of interest in pixels."), ("mask", "Black pixels are masked."), ("cov", "Coverage of the genome by reads."), ("lint", "region of the text that pylint reads")],
)
def test_doubt_is_settled_by_the_counts_of_templates(spark, name, doc):
    own = dp.own_words(name, None)
    assert dp.telling_text(doc, own) or dp.doubtful_text(doc, own)
    once = dp.judge(spark.createDataFrame([(1, name, None, None, doc, "t")], FUNCTIONS)).first()
    assert once.informative
    if not dp.telling_text(doc, own):
        often = dp.judge(spark.createDataFrame([(i, f"{name}{'abc'[i]}x", None, None, doc, "t") for i in range(3)] + [(9, "other", None, None, "Keeps order.", "t")], FUNCTIONS))
        assert {r.id for r in often.where("informative").collect()} == {9}
        # Copies under one name are one function.
        same = dp.judge(spark.createDataFrame([(i, name, None, None, doc, "t") for i in range(5)], FUNCTIONS))
        assert same.where("informative").count() == 5
