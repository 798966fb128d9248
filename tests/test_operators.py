"""Small fixtures for operators whose edge cases the tables do not hold."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import languages, naming, security
from lodestrata.operators import depgraph, extraction, files, pattern_search, sessions, store, symbols, text_search, vector_search
from lodestrata.plans import analysis


def values(spark, items, column):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r[1] for r in frame.select("i", column(F.col("v"))).orderBy("i").collect()]


def test_naming_styles(spark):
    names = {"get_user": "snake_case", "getUser": "camelCase", "GetUser": "PascalCase", "MAX_SIZE": "UPPER_CASE", "MAX": "PascalCase", "user": "flat_case", "my-name": "kebab-case", "_x_y": "snake_case", "__": "unknown", "": "unknown", "a_B": "mixed", None: "unknown"}
    assert values(spark, list(names), naming.naming_style) == list(names.values())


def test_languages(spark):
    assert values(spark, ["a/b.PY", "x.tar.rs", "Makefile", ".py", "a.unknown", None, "d.x/y"], languages.detect_language) == ["python", "rust", "unknown", "unknown", "unknown", None, "unknown"]
    assert values(spark, ["Py", "golang", "Elvish", None], languages.normalize_language) == ["python", "go", "Elvish", None]
    assert languages.extensions_of("TS") == ["ts", "tsx", "mts", "cts"] and languages.extensions_of("none") == []


def test_text_search_counts_context_and_ties(spark):
    f = spark.createDataFrame([("b", "x\nFoo\ny"), ("a", "x\nfoo\ny"), ("c", "\n".join(["foo"] * 9)), ("d", None), ("e", "")], "path string, content string")
    rows = text_search.search(f, "FOO").collect()
    assert [r.path for r in rows] == ["c", "a", "b"] and rows[0].n_hits == 5 and rows[1].first_line == 2
    hits = {(r.path, r.line): r for r in text_search.line_hits(f, "foo").collect()}
    assert len([k for k in hits if k[0] == "c"]) == 5 and hits["a", 2].context == "x\nfoo\ny" and hits["c", 1].context == "foo\nfoo"


def test_read_tree(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.py").write_text("x = 1\n")
    (tmp_path / "b.go").write_text("package b\n")
    (tmp_path / "c.txt").write_text("no code")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.read_tree(spark, str(tmp_path)).collect()) == ["a.py", "b.go"]
    assert [r.content for r in files.read_tree(spark, str(tmp_path), "go").collect()] == ["package b\n"]


def test_custom_expressions_are_guarded(spark):
    assert not pattern_search.is_allowed("(a+)+") and not pattern_search.is_allowed("(") and not pattern_search.is_allowed("x" * 2000) and pattern_search.is_allowed(r"a+b")
    f = spark.createDataFrame([("a", "python", "x = 1\nX = 2"), ("b", "go", None)], "path string, language string, content string")
    assert [(r.path, r.n_matches) for r in pattern_search.search(f, r"x\s=").collect()] == [("a", 2)]
    assert pattern_search.search(f, "(a+)+").count() == 0


def test_spans(spark):
    f = spark.createDataFrame([("a", "python", "é\n  ab ab\n"), ("b", "go", "ab"), ("c", "python", None)], "path string, language string, content string")
    rows = pattern_search.spans(f, [("r", "python", r"(?P<one>a)b")]).orderBy("column_start").collect()
    assert [(r.line_start, r.column_start, r.column_end, r.before, r.groups) for r in rows] == [(2, 3, 5, "é", {"one": "a"}), (2, 6, 8, "é", {"one": "a"})]


def test_vector_search(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [0.0, 2.0], "y"), ("c", [0.0, 0.0], "x"), ("d", None, "x"), ("e", [1.0], "x"), ("f", [3.0, 0.0], "x")], "id string, embedding array<float>, kind string")
    assert [(r.id, r.score) for r in vector_search.search(v, [1.0, 0.0]).collect()] == [("a", 1.0), ("f", 1.0)]
    assert [r.id for r in vector_search.search(v, [1.0, 0.0], threshold=None, filters={"kind": "y", "id": None}).collect()] == ["b"]


def test_upsert_last_wins_and_unique(spark):
    table = spark.createDataFrame([("1", "p", 1), ("2", "q", 1)], "id string, path string, n int")
    changes = spark.createDataFrame([("1", "p", 2, 1), ("1", "r", 3, 2), ("9", "q", 4, 1)], "id string, path string, n int, seq int")
    assert {tuple(r) for r in store.upsert(table, changes).collect()} == {("2", "q", 1), ("1", "r", 3), ("9", "q", 4)}
    assert {tuple(r) for r in store.upsert(table, changes, unique="path").collect()} == {("1", "r", 3), ("9", "q", 4)}
    assert store.upsert(table, changes.limit(0)).count() == 2


def test_tolerant_json(spark):
    f = spark.createDataFrame([('["a"]',), ("broken",), (None,), ("{}",)], "j string")
    assert [r[0] for r in f.select(store.json_strings("j")).collect()] == [["a"], [], [], []]


def test_like_escapes_wildcards(spark):
    f = spark.createDataFrame([("a_b",), ("axb",), ("A_B%",), (None,)], "n string")
    assert [r.n for r in store.like_search(f, "a_b", ["n"]).collect()] == ["a_b", "A_B%"]
    assert [r.n for r in store.like_search(f, "b%", ["n"]).collect()] == ["A_B%"]
    assert security.escape_like("50%_\\") == "50\\%\\_\\\\"


def test_memory_edit_replaces_the_first(spark):
    f = spark.createDataFrame([("a x b x",), ("none",), (None,)], "c string")
    assert [r[0] for r in f.select(sessions.edit_memory(F.col("c"), "x", "Y")).collect()] == ["a Y b x", None, None]


def test_custom_patterns_count_whole_texts(spark):
    far, many = "y" * (1 << 20) + "\nneedle7", "needle7\n" * 10_001
    f = spark.createDataFrame([("far", "python", far), ("many", "python", many)], "path string, language string, content string")
    assert {r.path: r.n_matches for r in pattern_search.search(f, r"needle\d").collect()} == {"far": 1, "many": 10_001}


def test_graph_closure_depth_and_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), ("a", "b"), ("d", None)], "source string, target string")
    reached = {(r.source, r.target): r.distance for r in depgraph.closure(e).collect()}
    assert reached["a", "a"] == 3 and reached["a", "d"] == 3 and ("d", "a") not in reached and reached["x", "x"] == 1
    assert {(r.cycle, r.length, r.severity) for r in depgraph.cycles(e).collect()} == {("a -> b -> c -> a", 3, "warning"), ("x -> x", 1, "error")}
    assert {r.node: r.coupling for r in depgraph.degrees(e.where("target IS NOT NULL")).collect()} == {"a": 2, "b": 2, "c": 3, "d": 1, "x": 2}
    assert depgraph.closure(e.limit(0)).count() == 0 and depgraph.cycles(e.limit(0)).count() == 0


def test_closure_has_no_last_distance(spark):
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(70)], "source string, target string").coalesce(1)
    assert depgraph.closure(e).agg(F.max("distance")).first()[0] == 70


def test_components_of_cycles_of_any_length(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 8}") for i in range(8)]
    e = spark.createDataFrame([*ring, ("r3", "r2"), ("r5", "s"), ("s", "t"), ("t", "u"), ("u", "t"), ("u", "v"), ("q", "r0"), ("x", "x"), ("x", None)], "source string, target string")
    got = {(r.component, r.node, r.n_nodes, r.shortest, r.severity) for r in depgraph.components(e).collect()}
    near = {2, 3}
    assert got == {("r0", f"r{i}", 8, 2 if i in near else 8, "error" if i in near else "warning") for i in range(8)} | {("t", "t", 2, 2, "error"), ("t", "u", 2, 2, "error"), ("x", "x", 1, 1, "error")}
    assert depgraph.components(e.limit(0)).count() == 0


def test_import_graph_queries_read_the_imports(spark, monkeypatch):
    edges = [(f"m{i}", f"m{(i + 1) % 7}") for i in range(7)]
    monkeypatch.setattr(analysis, "_edges", lambda *_: spark.createDataFrame(edges, "source string, target string"))
    run = lambda name: analysis.queries()[name](spark, "").collect()
    assert len(run("import_closure")) == 49 and {(r.node, r.depth) for r in run("import_depths")} == {(f"m{i}", 7) for i in range(7)}
    assert {(r.component, r.node, r.n_nodes) for r in run("import_cycles")} == {("m0", f"m{i}", 7) for i in range(7)}


def test_modules_and_relative_imports(spark):
    assert values(spark, ["a/b.py", "a/__init__.py", "a/b.test.ts"], depgraph.module_of) == ["a.b", "a", "a.b.test"]
    f = spark.createDataFrame([("r/a/b.py", "python", "import os\nfrom ..c import d\nfrom . import e\n"), ("r/a/x.ts", "typescript", 'import { y } from "../z/w";\nimport q from "q";\n')], "path string, language string, content string")
    edges = depgraph.edges_of(extraction.imports(f).withColumns({"is_stdlib": F.lit(False), "line": F.lit(0)}))
    assert {(r.source, r.target, r.edge_type) for r in edges.collect()} == {("r.a.b", "os", "direct"), ("r.a.b", "r.c", "relative"), ("r.a.b", "r.a", "relative"), ("r.a.x", "r.z.w", "relative"), ("r.a.x", "q", "direct")}


def test_python_symbols_and_errors(spark):
    text = '@d\nclass A(B):\n    """Doc."""\n    async def m(self, x: int = 1) -> str:\n        def inner(): pass\n    def __init__(self): pass\nLIMIT = 3\n'
    f = spark.createDataFrame([("a.py", text), ("b.py", "def ("), ("c.js", "x"), ("d.py", None)], "path string, content string")
    rows = {(r.path, r.qualified_name): r for r in extraction.python_symbols(f).collect()}
    assert rows["a.py", "A"].docstring == "Doc." and rows["a.py", "A"].decorators == ["d"] and rows["a.py", "A"].start_line == 2
    assert rows["a.py", "A.m"].kind == "method" and rows["a.py", "A.m"].is_async and rows["a.py", "A.m"].signature == "async def m(self, x: int=1) -> str"
    assert rows["a.py", "A.m.inner"].kind == "function" and rows["a.py", "A.m.inner"].parent == "m" and rows["a.py", "A.__init__"].kind == "constructor"
    assert rows["a.py", "LIMIT"].kind == "constant" and rows["b.py", None].kind == "error" and len(rows) == 6


def test_python_imports(spark):
    text = "import a.b as c\nfrom .d import e, f\nfrom g import *\nif TYPE_CHECKING:\n    import h\n"
    rows = {(r.module, r.name): r for r in extraction.python_imports(spark.createDataFrame([("a.py", text)], "path string, content string")).collect()}
    assert rows["a.b", None].kind == "import_alias" and rows["d", "e"].relative_level == 1 and rows["g", "*"].kind == "star_import" and rows["h", None].is_type_only


def test_name_paths(spark):
    rows = [(1, ["A", "b"], "method", 0), (2, ["b"], "function", 1), (3, ["A", "Bc"], "method", 0), (4, ["X", "A", "b"], "method", 2)]
    f = spark.createDataFrame(rows, "symbol_id int, parts array<string>, kind string, overload int")
    ids = lambda *a, **k: {r.symbol_id for r in symbols.find(f, *a, **k).collect()}
    assert ids("b") == {1, 2, 4} and ids("A/b") == {1, 4} and ids("/A/b") == {1} and ids("A/b[2]") == {4} and ids("B", substring=True) == {1, 2, 3, 4}
    assert ids("b", include=("function",)) == {2} and ids("b", exclude=("function",)) == {1, 4} and ids("") == set()


def test_edits(spark):
    f = spark.createDataFrame([("a\nb\nc",)], "c string")
    one = lambda col: f.select(col).first()[0]
    c = F.col("c")
    assert one(symbols.replace_body(c, F.lit(2), F.lit(3), F.lit("X"))) == "a\nX" and one(symbols.insert_after(c, F.lit(3), F.lit("X"))) == "a\nb\nc\nX"
    assert one(symbols.insert_before(c, F.lit(1), F.lit("X"))) == "X\na\nb\nc" and one(symbols.rename(F.lit("ab a$ a.a"), "a", "$z")) == "ab a$ $z.$z"


def test_enclosing_symbol(spark):
    s = spark.createDataFrame([(1, "f", 1, 10), (2, "f", 2, 5), (3, "f", 2, 4), (4, "g", 1, 9)], "symbol_id long, path string, start_line int, end_line int")
    p = spark.createDataFrame([(1, "f", 3), (2, "f", 5), (3, "f", 11), (4, "h", 1)], "point_id long, path string, line int")
    assert {r.point_id: r.symbol_id for r in symbols.enclosing(p, s).collect()} == {1: 3, 2: 2, 3: None, 4: None}


def test_session_counts_and_patch(spark):
    at = datetime(2024, 1, 1)
    s = spark.createDataFrame([("s1", "a", at, None), ("s2", "b", at, at), ("s1", "old", datetime(2023, 1, 1), at)], "id string, name string, updated_at timestamp_ntz, ended_at timestamp_ntz")
    current = sessions.current_sessions(s)
    assert {r.id: r.name for r in current.collect()} == {"s1": "a", "s2": "b"} and sessions.active(current).count() == 1
    d = spark.createDataFrame([("1", " S1 "), ("1", " S1 "), ("2", "s1"), ("3", ""), ("4", None)], "id string, session_id string")
    assert {r.id: r.n_decisions for r in sessions.with_decision_counts(current, d).collect()} == {"s1": 2, "s2": 0}
    assert {r.id: r.name for r in sessions.patch(current, spark.createDataFrame([("s2", "new")], "id string, name string")).collect()} == {"s1": "a", "s2": "new"}


@pytest.mark.parametrize("name", ["a.txt", "con", "a/b", "..", "x\\y"])
def test_safe_names(spark, name):
    assert values(spark, [name], security.is_safe_filename) == [name == "a.txt"]
