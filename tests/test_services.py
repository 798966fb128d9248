import json

from lodestrata.operators import services

FILES = "path string, language string, content string"


def sources(spark, text="class A:\n    def m(self): pass\nLIMIT = 1\n"):
    return spark.createDataFrame([("r/a.py", "python", text), ("r/b.go", "go", "package b // class"), ("r/c.py", "python", None)], FILES)


def test_search_falls_back_and_clamps(spark):
    f = sources(spark)
    assert [r.key for r in services.search_codebase(f, "class", "nonsense", limit=0).collect()] == ["r/b.go"]
    assert {(r.key, r.search_type) for r in services.search_codebase(f, "py_class", "pattern").collect()} == {("r/a.py", "pattern")}
    v = spark.createDataFrame([("v1", [1.0, 0.0], "python"), ("v2", [1.0, 0.0], "go")], "id string, embedding array<float>, language string")
    found = services.search_codebase(f, "x", "semantic", language="go", vectors=v, embed=lambda _: [1.0, 0.0]).collect()
    assert [(r.key, r.search_type) for r in found] == [("v2", "semantic")]


def test_learning_again_replaces_rows(spark, tmp_path):
    for version in (0, 1):
        services.persist(spark, services.learn(sources(spark)), str(tmp_path), version)
    services.persist(spark, services.learn(sources(spark, "class B: pass\n")), str(tmp_path), 2)
    read = lambda v: {(r.name, r.concept_type) for r in spark.read.parquet(f"{tmp_path}/concepts/{v}").collect()}
    assert read(0) == read(1) == {("A", "class"), ("m", "method"), ("LIMIT", "constant")}
    assert read(2) == read(1) | {("B", "class")}


def test_blueprint_has_every_repository(spark):
    f = spark.createDataFrame([("a/api/x.py", "python", "import flask\n"), ("a/models/cli.py", "python", ""), ("b/one.go", "go", "")], FILES)
    rows = {r.repo: r for r in services.blueprint(f).collect()}
    assert rows["a"].frameworks == "Flask" and rows["a"].style == "API-First" and rows["a"].n_entry_points == 1 and rows["a"].directories == "api:api,models:models"
    assert rows["b"].style == "" and rows["b"].languages == "go"


def test_registry_leaves_out_broken_and_missing(spark, tmp_path):
    path = tmp_path / "registry.json"
    path.write_text("\n".join([json.dumps({"path": "/a", "activated_at": "2024-01-01T00:00:00"}), json.dumps({"path": "/b"}), "{broken", json.dumps({"path": "/gone"})]))
    existing = spark.createDataFrame([("/a",), ("/b",)], "path string")
    assert [r.path for r in services.read_registry(spark, str(path), existing).collect()] == ["/a", "/b"]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], FILES)
    assert services.blueprint(empty).count() == 0 and services.learn(empty)["concepts"].count() == 0 and services.search_codebase(empty, "x").count() == 0
