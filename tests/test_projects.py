import pytest
from pyspark.sql import functions as F

from lodestrata.functions import security
from lodestrata.operators import depgraph, extraction, projects, services, store
from lodestrata.operators.symbols import definitions, find_unique


def test_paths_cannot_leave_their_root(spark):
    rows = [("a/b.py",), ("../x",), ("a/../../y",), ("",), ("/etc/passwd",), ("/r/a/./b",), ("a//b/",), (None,), ("a\x00b",), ("..",), ("a/..",)]
    got = {r.p: r.j for r in spark.createDataFrame(rows, "p string").select("p", security.safe_join("/r/", F.col("p")).alias("j")).collect()}
    assert got == {"a/b.py": "/r/a/b.py", "../x": None, "a/../../y": None, "": None, "/etc/passwd": None, "/r/a/./b": "/r/a/b", "a//b/": "/r/a/b", None: None, "a\x00b": None, "..": None, "a/..": "/r"}
    inside = {r.p: (r.a, r.b, r.c) for r in spark.createDataFrame([("/r",), ("/r/x",), ("/rx",)], "p string").select("p", security.is_within(F.col("p"), ["/r"]).alias("a"), security.is_within(F.col("p"), None).alias("b"), security.is_within(F.col("p"), []).alias("c")).collect()}
    assert inside == {"/r": (True, True, False), "/r/x": (True, True, False), "/rx": (False, True, False)}
    uris = {r.u: r.v for r in spark.createDataFrame([("file:///r/a.py",), ("file:///q/a.py",), ("a.py",)], "u string").select("u", security.uri_to_relative(F.col("u"), "/r").alias("v")).collect()}
    assert uris == {"file:///r/a.py": "a.py", "file:///q/a.py": "/q/a.py", "a.py": "a.py"}
    texts = [r.p for r in spark.createDataFrame([("a.PY",), (".env",), ("x/.GitIgnore",), ("a.png",), ("py",), (".py",), ("a.b.md",)], "p string").where(security.is_text_file(F.col("p"))).collect()]
    assert texts == ["a.PY", ".env", "x/.GitIgnore", "a.b.md"]


IMPORTS = [
    ("a.py", "python", "import os, sys as s, a.b\nfrom x import *\nfrom ..y import z\nimport json # c\n", {("import", "os", True), ("import", "sys", True), ("import", "a.b", False), ("star_import", "x", False), ("relative", "y", False), ("import", "json", True)}),
    ("a.go", "go", 'import f "fmt"\nimport (\n\t"os"\n\t_ "x/y"\n)\n', {("import", "fmt", False), ("import", "os", False), ("import", "x/y", False)}),
    ("a.ts", "typescript", "import a, { b } from 'm';\nimport type { T } from './t';\nimport 'side';\nconst q = require('r');\nawait import('dyn');\nimport * as n from \"n\";\n",
     {("import", "m", False), ("relative", "t", False), ("import", "side", False), ("require", "r", False), ("dynamic", "dyn", False), ("import", "n", False)}),
    ("A.java", "java", "import a.B;\nimport static c.D.e;\nimport f.*;\n", {("import", "a.B", False), ("import", "c.D.e", False), ("import", "f", False)}),
    ("a.rs", "rust", "use std::io::Read;\npub use a::b::{c, d};\nuse x;\n", {("import", "std::io::Read", False), ("import", "a::b", False), ("import", "x", False)}),
]


@pytest.mark.parametrize(("path", "language", "text", "expected"), IMPORTS)
def test_imports(spark, path, language, text, expected):
    out = extraction.imports(spark.createDataFrame([(path, language, text)], "path string, language string, content string"))
    assert {(r.kind, r.module, r.is_stdlib) for r in out.collect()} == expected


def test_cycles_of_any_length_and_a_long_chain(spark):
    nine = [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)]
    shortcut = [("c0", "c7")]
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(200)]
    edges = spark.createDataFrame(nine + shortcut + chain + [("c3", "n000"), ("x", "y"), ("y", "x"), (None, "x")], "source string, target string")
    got = {(r.cycle, r.length, r.severity) for r in depgraph.cycles(edges).collect()}
    assert got == {(" -> ".join([*(f"c{i}" for i in range(9)), "c0"]), 9, "warning"), ("c0 -> c7 -> c8 -> c0", 3, "warning"), ("x -> y -> x", 2, "error")}
    reached = depgraph.closure(spark.createDataFrame(chain, "source string, target string"))
    assert reached.count() == 200 * 201 // 2 and reached.agg(F.max("distance")).first()[0] == 200


def test_graph_documents(spark):
    edges = spark.createDataFrame([("a", "b", "direct"), ("a", "c", "relative"), ("b", "a", None)], "source string, target string, edge_type string")
    documents = depgraph.to_json(edges).unionByName(spark.createDataFrame([("broken",), (None,), ("{}",)], "document string"))
    assert {tuple(r) for r in depgraph.from_json(documents).collect()} == {("a", "b", "direct"), ("a", "c", "relative"), ("b", "a", None)}


def test_store_upkeep(spark, tmp_path):
    frame = spark.range(10).repartition(5)
    frame.write.parquet(f"{tmp_path}/t/0")
    store.compact(spark, f"{tmp_path}/t/0", f"{tmp_path}/t/1", 4)
    assert store.backup(spark, f"{tmp_path}/t/1", f"{tmp_path}/b") == 10 and spark.read.parquet(f"{tmp_path}/t/1").count() == 10
    with pytest.raises(Exception):  # noqa: B017
        store.backup(spark, f"{tmp_path}/t/1", f"{tmp_path}/b")
    assert store.drop_collection(spark, str(tmp_path), "t") and not store.drop_collection(spark, str(tmp_path), "t")
    empty = store.cleared({"a": frame})
    assert empty["a"].count() == 0 and empty["a"].columns == ["id"]
    back = store.rollback(spark.createDataFrame([(1,), (2,), (2,), (4,)], "version int"), spark.createDataFrame([(1, "x"), (2, "y")], "version int, down string"))
    assert [(r.version, r.statement, r.place) for r in back.orderBy("place").collect()] == [(4, None, 1), (2, "y", 2), (1, "x", 3)]


def test_backends(spark):
    known = projects.Backends()
    files = spark.createDataFrame([("a",)], "path string")
    with pytest.raises(ValueError, match="no backend"):
        known.extract(files)
    known.register("low", 1, lambda f: f.withColumn("v", F.lit(0)))
    known.register("high", 5, lambda f: f.withColumn("v", F.lit(1)))
    known.register("low", 2, lambda f: f.withColumn("v", F.lit(2)))
    assert known.names() == ["high", "low"] and {(r.v, r.backend, r.priority) for r in known.extract(files).collect()} == {(1, "high", 5), (2, "low", 2)}
    assert projects.available_searches(None, len) == ["text", "pattern"] and projects.available_searches(files, len)[-1] == "semantic"


def test_embedding_and_registry(spark, tmp_path):
    rows = spark.createDataFrame([(1, "cache entry"), (2, None), (3, ""), (4, "cache entries"), (5, "zebra")], "id int, text string")
    got = {r.id: r.embedding for r in projects.embedded(rows, "text", projects.hashed_words, batch=2).collect()}
    assert got[2] is None and got[3] is None and abs(sum(v * v for v in got[1]) - 1) < 1e-5
    dot = lambda a, b: sum(x * y for x, y in zip(got[a], got[b]))
    assert dot(1, 4) > 0.6 > dot(1, 5)
    registered = spark.createDataFrame([("p",), ("q",)], "path string").withColumn("activated_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    projects.write_registry(registered, f"{tmp_path}/reg")
    assert [r.path for r in services.read_registry(spark, f"{tmp_path}/reg", registered.where("path = 'q'")).collect()] == ["q"]
    assert len({r.request_id for r in projects.request_ids(rows).collect()}) == 5


def test_unique_names_and_definitions(spark):
    s = spark.createDataFrame([("a", "p", 1, "class"), ("a", "q", 2, "class"), ("b", "p", 3, "method"), (None, "p", 4, "class")], "name string, path string, start_line int, kind string")
    assert [r.name for r in find_unique(s).collect()] == ["b"]
    assert {tuple(r) for r in definitions(spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "name string"), s).collect()} == {("a", "p", 1, "class"), ("a", "q", 2, "class")}
