import pytest

from lodestrata.llm import provenance as pv

HAND = "import { a } from \"./b\";\n\n" + "\n".join(f"export function step{i}(value) {{\n  return value + {i} * factor;\n}}" for i in range(30))


@pytest.mark.parametrize(
    ("path", "kind"),
    [
        ("r/vendor/x/a.go", "vendored"), ("r/node_modules/x/lib/a.js", "vendored"), ("r/third_party/a.ts", "vendored"), ("r/external/lib-1.2.3/a.go", "vendored"), ("r/src/contrib/Lib-0.1/A.java", "vendored"), ("r/site-packages/p/a.py", "vendored"),
        ("r/generated/a.ts", "generated"), ("r/a/gen/b.py", "generated"), ("r/a/autogen/b.go", "generated"), ("r/dist/a.js", "generated"), ("r/a/b.min.js", "generated"), ("r/a/b_pb2.py", "generated"), ("r/a/b.pb.go", "generated"),
        ("r/a/b.gen.ts", "generated"), ("r/a/b_pb.js", "generated"), ("r/package-lock.json", "generated"), ("r\\vendor\\a.py", "vendored"),
        ("vendor/a.py", None), ("r/vendors/a.py", None), ("r/third_parties/a.js", None), ("r/externals_api/a.py", None), ("r/generators/a.py", None), ("r/distribution/a.py", None), ("r/a/settings.json", None), ("r/a/minimal.js", None), ("r/a/gen.py", None), ("a.py", None),
    ],
)
def test_paths(spark, path, kind):
    row = spark.createDataFrame([(path,)], "path string").select(pv.path_kind(pv.F.col("path")).alias("k")).first()
    assert row.k == kind


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("// Code generated by x 1.2. DO NOT EDIT.\npackage a", "generated"), ("# SPDX-License-Identifier: MIT\n#\n# @generated by x\nx = 1", "generated"), ("/*\n * AUTO-GENERATED FILE - edit the template instead\n */\nx", "generated"),
        ("// Automatisch erzeugt aus a.def - nicht bearbeiten\r\nx", "generated"), ("# Autogenerated on every build\rx", "generated"), ("/*! lib v1.2 | (c) 2020 lib contributors | MIT License */\nx", "vendored"),
        ("// Copied verbatim from lib 1.0, send changes upstream.\nx", "vendored"), ("/**\n * @license lib\n */", "vendored"), ("# lib 1.0\n# Copyright (c) 2009 the lib authors. Released under the MIT license.\n", "vendored"),
        ("// Edit by hand: the auto-generated version was dropped.\nx", None), ("// This module writes files that start with DO NOT EDIT, but is itself maintained by the a team.\nx", None), ("// Helpers for generated a reports.\nx", None),
        ("// The minified bundle is checked by the a tests.\nx", None), ("/** Auto-generated method stub */\nfunction f() {}", None), ("// SPDX-License-Identifier: MIT\nx", None), ("x = 1\n# Code generated by y. DO NOT EDIT.", None),
        ("EXAMPLE = '# Code generated by y. DO NOT EDIT.'", None), ("", None),
        ("// licence line\n" * 40 + "// Code generated by protoc. DO NOT EDIT.\nx", "generated"), ('"""A module.\n\nThis file was\ngenerated by x 1.0.\n"""\nx = 1', "generated"), ("<!-- AUTO-GENERATED, do not modify -->\nx", "generated"),
        ("# Sends mail to all contributors of the repo.\nx", None), ("# do not modify the cache here\nx", None), ("// Code generated by gen. Helpers for tests of the queue.\nx", "generated"), ("# Reads what was generated by hand.\nx", None),
        ("// This file is not generated by a tool.\nx", None), ("// Please do not edit this file by hand!\nx", "generated"), ("/* Any changes made here will be overwritten. */x", "generated"), ("// @license MIT\nx", None),
    ],
)
def test_notices(text, kind):
    assert pv.notice_kind(text) == kind


def test_own_copyright_is_not_a_third_partys():
    head = "# Copyright (c) 2009 the lib authors. Released under the MIT license.\nx"
    assert pv.notice_kind(head, "lib") is None and pv.notice_kind(head, "other") == "vendored"


def test_whole_head_is_read():
    lines = [f"// line {i}" for i in range(500)]
    assert len(pv.head_comments("\n".join(lines) + "\ncode\n// more")) == 500


def test_shapes():
    assert pv.shape_kind("const t = [\n" + ", ".join(str(i * 7 % 256) for i in range(400)) + "\n];") == "data"
    assert pv.shape_kind('x = "' + "ab12" * 300 + '"') == "data"
    assert pv.shape_kind("X = (\n" + "\n".join('    "' + "Qb+/" * 19 + '"' for _ in range(12)) + "\n)") == "data"
    assert pv.shape_kind("!function(e,t){" + "for(var i=0;i<9;i++)a.push(i);" * 40 + "}(this);") == "minified"
    assert pv.shape_kind("STEPS = [" + ", ".join(map(str, range(30))) + "]\n" + HAND) is None
    assert pv.shape_kind(HAND) is None and pv.shape_kind("") is None and pv.shape_kind("a" * 100) is None


def test_frame(spark):
    changed_copy = HAND.replace("step3", "other").replace("step4", "more")
    rows = [
        ("r/vendor/lib/a.js", HAND, "k"), ("r/api/copy.js", changed_copy, "k"), ("r/api/own.js", HAND.replace("value", "amount"), "k"), ("r/api/gone.min.js", None, "k"), ("r/api/none.py", None, "k"), ("r/api/empty.py", "", "k"), (None, "x", "k"),
        ("r/vendor/lib/s.js", "a();\nb();\nc();\n", "k"), ("r/api/s.js", "// own note\na();\n  b();\n\nc();\n", "k"), ("r/api/t.js", "a();\nb();\n", "k"),
        ("r/api/data.json", "[" + "1," * 500 + "1]", "k"),
    ]
    got = {r.path: (r.kind, r.reason) for r in pv.classify(spark.createDataFrame(rows, "path string, content string, kind string")).collect()}
    assert got == {
        "r/vendor/lib/a.js": ("vendored", "path"), "r/api/copy.js": ("vendored", "copy"), "r/api/own.js": (None, None), "r/api/gone.min.js": ("generated", "path"), "r/api/none.py": (None, None), "r/api/empty.py": (None, None), "r/api/data.json": (None, None),
        "r/vendor/lib/s.js": ("vendored", "path"), "r/api/s.js": ("vendored", "copy"), "r/api/t.js": (None, None),
    }
    assert pv.classify(spark.createDataFrame([], "path string, content string")).count() == 0
