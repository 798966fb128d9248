"""Metrics against a plain restatement of their definitions."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestrata.operators import metrics as m

SOURCES = [
    "", "\n\n", "x = 1", 'def f(a):\n    """Doc."""\n    if a and b:\n        return 1\n    elif c or d:\n        pass\n    else:\n        for i in x:\n            yield i\n    return None\n',
    '"""\nopen\n# inside\n"""\nx = 2 # y\n', "/* a\nb */\nint x = 3;\n// c\nif (a && b || c) { d(); }\n", "  \t\nclass A:\n    def g(self): return self.x == 1\n", "x if y else z if w else v\n", "a <= b != c\ns = 'it''s'\n",
]


def loc(text):
    code = comments = blank = logical = 0
    in_string = in_block = False
    lines = text.split("\n")
    for line in (x.strip() for x in lines):
        if not line:
            blank += 1
        elif '"""' in line or "'''" in line:
            quote = '"""' if '"""' in line else "'''"
            in_string ^= line.count(quote) == 1
            comments += 1
        elif in_string or line.startswith(("#", "//")):
            comments += 1
        elif "/*" in line:
            in_block = "*/" not in line
            comments += 1
        elif in_block:
            in_block = "*/" not in line
            comments += 1
        else:
            code += 1
            plain = "=" in line and not any(op in line for op in ("==", "!=", "<=", ">="))
            logical += any(w in line for w in m.LOGICAL_WORDS) or line.endswith((";", ":")) or plain
    return len(lines), code, comments, blank, logical


def cyclomatic(text, lang):
    total = 1
    for key in m.decision_set(lang):
        total += text.count(key) if key in m.LITERALS else len(re.findall(rf"\b{key}\b", text))
    if lang == "python":
        total -= len(re.findall(r"\bif\b.*\belse\b", text)) // 2
    return max(1, total)


def cognitive(text):
    value = depth = 0
    for line in (x.strip() for x in text.split("\n")):
        if not line or line.startswith("#"):
            continue
        for word in re.findall(r"\b\w+\b", line):
            value += 1 + depth if word in m.NESTING else word in m.STRUCTURAL
            value += word in ("and", "or")
        if any(w + ":" in line or w + " " in line for w in m.NESTING):
            depth += 1
        elif line == "pass" or line.startswith("return"):
            depth = max(0, depth - 1)
        value += line.count("&&") + line.count("||")
    return value


def check(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    c = frame.content
    out = frame.select("id", m.lines_of_code(c).alias("l"), m.cyclomatic(c).alias("p"), m.cyclomatic(c, "typescript").alias("t"), m.cognitive(c).alias("g")).collect()
    for row in out:
        text = texts[row.id]
        assert tuple(row.l) == loc(text)
        assert (row.p, row.t) == (cyclomatic(text, "python"), cyclomatic(text, "typescript"))
        assert row.g == cognitive(text)


def test_examples(spark):
    check(spark, SOURCES)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["if x:", "  return y", "else:", '"""', "# c", "/* d", "*/", "x = 1", "", "pass", "while a and b:", "f(); // e", "'''a'''"]), max_size=12).map("\n".join), min_size=1, max_size=30))
def test_generated(spark, texts):
    check(spark, texts)


def test_halstead_and_maintainability(spark):
    frame = spark.createDataFrame([(1, "a = b + b * 2\n"), (2, ""), (3, "x == y # z\n'str'")], "id int, content string")
    rows = {r.id: r for r in m.analyse(frame).collect()}
    assert (rows[1].halstead_n1, rows[1].halstead_t1, rows[1].halstead_n2, rows[1].halstead_t2) == (3, 3, 3, 4)
    assert rows[1].volume == pytest.approx(7 * 2.584962, abs=1e-3) and rows[1].difficulty == 2.0
    assert rows[2].maintainability == 100.0 and rows[2].volume == 0.0
    assert (rows[3].halstead_n1, rows[3].halstead_n2) == (1, 2)


def test_null_text_gives_nulls(spark):
    row = m.analyse(spark.createDataFrame([(1, None)], "id int, content string")).first()
    assert row.id == 1 and row.cognitive is None
