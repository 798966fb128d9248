"""Code metrics (F5): lines, cyclomatic, cognitive, Halstead, maintainability, and the rules built on them.

Order-dependent scans are folds over the array of lines inside one row, so nothing is shuffled to compute them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.naming import naming_style, violates
from lodestrata.operators.text_search import strip

#: Decision keywords per language; those in LITERALS are counted as text, not as words.
DECISIONS = {
    "python": ("if", "elif", "else", "for", "while", "except", "with", "and", "or", "assert", "case"),
    "typescript": ("if", "else", "for", "while", "do", "switch", "case", "catch", "finally", "&&", "||", "?", ":"),
    "go": ("if", "else", "for", "switch", "case", "select", "defer", "go", "&&", "||"),
    "rust": ("if", "else", "for", "while", "loop", "match", "?", "&&", "||"),
}
LITERALS = ("&&", "||", "?", ":")
#: Halstead operators; longer ones are counted first, equally long ones in this order.
OPERATORS = ("and", "not", "**", "==", "!=", "<=", ">=", "or", "in", "is", "&&", "||", "->", "=>", "::", "=", "+", "-", "*", "/", "%", "<", ">", "!", ".", ",", ":", ";", "(", ")", "[", "]", "{", "}")
#: Words that are no operands, besides the language's decision keywords.
NO_OPERANDS = ("def", "class", "return", "import", "from", "as")
#: Words that begin a nested block, and words that add one without nesting.
NESTING = ("if", "for", "while", "with", "try", "except", "class", "def")
STRUCTURAL = ("elif", "else", "finally", "case")
LOGICAL_WORDS = ("def ", "class ", "if ", "for ", "while ", "return ", "yield ")
#: What is removed before operators and operands are counted, in this order.
CLEANING = (
    r'(?s)""".*?"""',
    r"(?s)'''.*?'''",
    r'"[^"\\]*(?:\\.[^"\\]*)*"',
    r"'[^'\\]*(?:\\.[^'\\]*)*'",
    r"#[^\n]*",
    r"//[^\n]*",
    r"(?s)/\*.*?\*/",
)
#: Upper bounds of the levels low, moderate and high.
CYCLOMATIC_LEVELS = (10, 20, 50)
COGNITIVE_LEVELS = (5, 15, 25)
LEVELS = ("low", "moderate", "high", "very_high")


def decision_set(language: str) -> tuple[str, ...]:
    return DECISIONS.get({"javascript": "typescript"}.get(language, language), DECISIONS["python"])


def literal_count(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def word_count(text: Column, *words: str) -> Column:
    return F.regexp_count(text, F.lit(r"\b(?:" + "|".join(words) + r")\b"))


def level(value: Column, bounds: tuple[int, int, int]) -> Column:
    return F.when(value <= bounds[0], LEVELS[0]).when(value <= bounds[1], LEVELS[1]).when(value <= bounds[2], LEVELS[2]).otherwise(LEVELS[3])


def level_rank(name: Column) -> Column:
    """Ordinal of a level, high for unknown ones."""
    return F.when(name == "low", 0).when(name == "moderate", 1).when(name == "very_high", 3).otherwise(2)


def lines_of_code(text: Column) -> Column:
    """struct(total, code, comments, blank, logical) by a fold over the lines: quotes and block comments span lines."""
    lines = F.transform(F.split(text, "\n", -1), strip)
    quoted = lambda s: s.contains('"""') | s.contains("'''")
    start = F.struct(*[F.lit(0).alias(n) for n in ("code", "comments", "blank", "logical")], F.lit(False).alias("in_string"), F.lit(False).alias("in_block"))

    def step(acc: Column, s: Column) -> Column:
        quote_count = F.when(s.contains('"""'), literal_count(s, '"""')).otherwise(literal_count(s, "'''"))
        opens, closes = s.contains("/*"), s.contains("*/")
        marked = s.startswith("#") | s.startswith("//")
        in_string, in_block = acc["in_string"], acc["in_block"]
        words = F.lit(False)
        for w in LOGICAL_WORDS:
            words = words | s.contains(w)
        compares = s.contains("==") | s.contains("!=") | s.contains("<=") | s.contains(">=")
        logical = words | s.endswith(";") | s.endswith(":") | (s.contains("=") & ~compares)
        kind = (
            F.when(s == "", "blank")
            .when(quoted(s), "quote")
            .when(in_string, "comment")
            .when(marked, "comment")
            .when(opens, "open")
            .when(in_block, "inside")
            .otherwise("code")
        )
        comment = kind.isin("comment", "open", "inside", "quote")
        is_code = kind == "code"
        return F.struct(
            (acc["code"] + is_code.cast("int")).alias("code"),
            (acc["comments"] + comment.cast("int")).alias("comments"),
            (acc["blank"] + (kind == "blank").cast("int")).alias("blank"),
            (acc["logical"] + (is_code & logical).cast("int")).alias("logical"),
            F.when((kind == "quote") & (quote_count == 1), ~in_string).otherwise(in_string).alias("in_string"),
            F.when(kind == "open", ~closes).when((kind == "inside") & closes, F.lit(False)).otherwise(in_block).alias("in_block"),
        )

    return F.aggregate(lines, start, step, lambda acc: F.struct(F.size(lines).alias("total"), acc["code"].alias("code"), acc["comments"].alias("comments"), acc["blank"].alias("blank"), acc["logical"].alias("logical")))


def by_language(language: str | Column, measure: Callable[[str], Column]) -> Column:
    """A measure that depends on the language, for a fixed one or for that of each row; languages without words of their own have Python's."""
    if isinstance(language, str):
        return measure(language)
    cases = F.when(F.lit(False), measure("python"))
    for name in ("python", *DECISIONS, "javascript"):
        cases = cases.when(language == name, measure(name))
    return cases.otherwise(measure("other"))


def cyclomatic(text: Column, language: str | Column = "python") -> Column:
    """1 + decision words and signs in the raw text; for Python less half of the lines with a conditional expression; at least 1."""
    return by_language(language, lambda name: _cyclomatic(text, name))


def _cyclomatic(text: Column, language: str) -> Column:
    keys = decision_set(language)
    words = [k for k in keys if k not in LITERALS]
    total = F.lit(1) + word_count(text, *words)
    for sign in [k for k in keys if k in LITERALS]:
        total = total + literal_count(text, sign)
    if language == "python":
        total = total - F.floor(F.regexp_count(text, F.lit(r"\bif\b[^\n]*\belse\b")) / 2).cast("int")
    return F.when(text.isNotNull(), F.greatest(total, F.lit(1))).cast("int")


def cognitive(text: Column) -> Column:
    """Structural words weigh one plus the nesting that the lines before have built up; a fold with a floor at 0."""
    lines = F.transform(F.split(text, "\n", -1), strip)

    def step(acc: Column, s: Column) -> Column:
        n_nesting, n_flat, n_bool = word_count(s, *NESTING), word_count(s, *STRUCTURAL), word_count(s, "and", "or")
        skip = (s == "") | s.startswith("#")
        deeper = F.lit(False)
        for w in NESTING:
            deeper = deeper | s.contains(w + ":") | s.contains(w + " ")
        added = n_nesting * (1 + acc["depth"]) + n_flat + n_bool + literal_count(s, "&&") + literal_count(s, "||")
        depth = F.when(deeper, acc["depth"] + 1).when((s == "pass") | s.startswith("return"), F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        return F.struct(
            F.when(skip, acc["value"]).otherwise(acc["value"] + added).cast("int").alias("value"),
            F.when(skip, acc["depth"]).otherwise(depth).cast("int").alias("depth"),
        )

    return F.aggregate(lines, F.struct(F.lit(0).alias("value"), F.lit(0).alias("depth")), step, lambda acc: acc["value"])


def cleaned(text: Column) -> Column:
    for pattern in CLEANING:
        text = F.regexp_replace(text, pattern, "")
    return text


def operator_counts(clean: Column) -> Column:
    """struct(n1, t1): distinct and total operators of a cleaned text; a fold that blanks what each operator has taken."""
    operators = F.array(*[F.lit(op) for op in sorted(OPERATORS, key=len, reverse=True)])

    def step(acc: Column, op: Column) -> Column:
        size = F.length(op)
        found = ((F.length(acc["rest"]) - F.length(F.replace(acc["rest"], op, F.lit("")))) / size).cast("int")
        return F.struct(F.replace(acc["rest"], op, F.repeat(F.lit(" "), size)).alias("rest"), (acc["n1"] + F.when(found > 0, 1).otherwise(0)).alias("n1"), (acc["t1"] + found).alias("t1"))

    start = F.struct(clean.alias("rest"), F.lit(0).alias("n1"), F.lit(0).alias("t1"))
    return F.aggregate(operators, start, step, lambda acc: F.struct(acc["n1"].alias("n1"), acc["t1"].alias("t1")))


def operands(clean: Column, language: str | Column = "python") -> Column:
    """The identifiers, without keywords, and numbers of a cleaned text."""
    found = F.regexp_extract_all(clean, F.lit(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"), 0)
    names = by_language(language, lambda name: F.filter(found, lambda w: ~w.isin(*decision_set(name), *NO_OPERANDS)))
    return F.concat(names, F.regexp_extract_all(clean, F.lit(r"\b\d+\.?\d*\b"), 0))


def halstead(frame: DataFrame, counts: str = "counts") -> DataFrame:
    """Adds vocabulary, length, volume, difficulty, effort, time and bugs; zero where a divisor is."""
    n1, n2, t1, t2 = (F.col(f"{counts}.{c}") for c in ("n1", "n2", "t1", "t2"))
    with_sizes = frame.withColumns({"vocabulary": n1 + n2, "halstead_length": t1 + t2})
    volume = F.when(F.col("vocabulary") > 0, F.col("halstead_length") * F.log2(F.col("vocabulary").cast("double"))).otherwise(0.0)
    difficulty = F.when(n2 > 0, n1 / 2.0 * t2 / n2).otherwise(0.0)
    sized = with_sizes.withColumns({"volume": volume, "difficulty": difficulty})
    return sized.withColumn("effort", F.col("difficulty") * F.col("volume")).withColumns({"time": F.col("effort") / 18.0, "bugs": F.col("volume") / 3000.0})


def maintainability(volume: Column, complexity: Column, code_lines: Column) -> Column:
    """0 to 100; 100 where volume or lines are not positive."""
    raw = (171 - 5.2 * F.log(volume) - 0.23 * complexity - 16.2 * F.log(code_lines.cast("double"))) * 100 / 171
    return F.when((volume <= 0) | (code_lines <= 0), 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))


def analyse(texts: DataFrame, language: str | Column = "python") -> DataFrame:
    """All metrics of each text: texts (…, content) keep their other columns. language: that of all texts, or a column of them."""
    keep = [c for c in texts.columns if c != "content"]
    content = F.col("content")
    # What several results use is a column first, so that it is computed once.
    language = language if isinstance(language, str) else language.alias("_language")
    clean = texts.select(*keep, "content", cleaned(content).alias("_clean"), *([] if isinstance(language, str) else [language]))
    language = language if isinstance(language, str) else F.col("_language")
    listed = clean.select(
        *keep, lines_of_code(content).alias("loc"), cyclomatic(content, language).alias("cyclomatic"), cognitive(content).alias("cognitive"),
        operator_counts(F.col("_clean")).alias("_ops"), operands(F.col("_clean"), language).alias("_operands"),
    )
    counts = F.struct(F.col("_ops.n1").alias("n1"), F.size(F.array_distinct("_operands")).alias("n2"), F.col("_ops.t1").alias("t1"), F.size("_operands").alias("t2"))
    basic = listed.select(*keep, "loc", "cyclomatic", "cognitive", counts.alias("counts"))
    return halstead(basic).select(
        *keep,
        *[F.col(f"loc.{c}").alias(f"loc_{c}") for c in ("total", "code", "comments", "blank", "logical")],
        "cyclomatic",
        level(F.col("cyclomatic"), CYCLOMATIC_LEVELS).alias("cyclomatic_level"),
        "cognitive",
        level(F.col("cognitive"), COGNITIVE_LEVELS).alias("cognitive_level"),
        *[F.col(f"counts.{c}").alias(f"halstead_{c}") for c in ("n1", "n2", "t1", "t2")],
        *[F.round(c, 4).alias(c) for c in ("volume", "difficulty", "effort", "time", "bugs")],
        F.round(maintainability(F.col("volume"), F.col("cyclomatic"), F.col("loc.code")), 4).alias("maintainability"),
    )


def symbol_texts(symbols: DataFrame, contents: DataFrame) -> DataFrame:
    """(symbol columns, content) with the lines of each symbol (path, start_line, end_line) cut out of its file."""
    lines = F.split("content", "\n", -1)
    return symbols.join(contents.select("path", "content"), "path").withColumn(
        "content", F.array_join(F.slice(lines, F.greatest("start_line", F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    )


def hotspots(measured: DataFrame, minimum: str = "high") -> DataFrame:
    """Rows whose cyclomatic or cognitive level is at least the given one."""
    least = level_rank(F.lit(minimum))
    return measured.where((level_rank(F.col("cyclomatic_level")) >= least) | (level_rank(F.col("cognitive_level")) >= least))


def refactorings(measured: DataFrame, name: str = "name") -> DataFrame:
    """(…, suggestion, priority) of measured functions with a dominant style column ``expected``."""
    cyc, cog, mi = F.col("cyclomatic"), F.col("cognitive"), F.col("maintainability")
    heavy, medium = (cyc > 20) | (cog > 25), (cyc > 10) | (cog > 15)
    size_kind = F.when(heavy, "extract_method").when(medium, "reduce_complexity")
    size_priority = F.when(heavy, F.when(cyc > 30, "critical").otherwise("high")).when(medium, F.when(F.col("cyclomatic_level") == "high", "high").otherwise("medium"))
    rows = F.array(
        F.struct(size_kind.alias("suggestion"), size_priority.alias("priority")),
        F.struct(F.when(mi < 40, "improve_maintainability").alias("suggestion"), F.when(mi < 25, "high").otherwise("medium").alias("priority")),
        F.struct(F.when(violates(naming_style(F.col(name)), F.col("expected")), "rename").alias("suggestion"), F.lit("low").alias("priority")),
    )
    keep = [c for c in measured.columns]
    return measured.select(*keep, F.inline(F.filter(rows, lambda r: r["suggestion"].isNotNull())))


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "critical", 0).when(priority == "high", 1).when(priority == "medium", 2).otherwise(3)


def health(average_cyclomatic: Column, average_mi: Column, n_languages: Column, n_files: Column, n_key_dirs: Column) -> Column:
    """100 less penalties, at least 0; healthy from 60 on."""
    penalty = (
        F.when(average_cyclomatic > 30, 20).when(average_cyclomatic > 15, 10).otherwise(0)
        + F.when(average_mi < 50, 15).otherwise(0)
        + F.when(n_languages > 3, 5).otherwise(0)
        + F.when((n_files > 500) & (n_key_dirs == 0), 10).otherwise(0)
    )
    return F.greatest(F.lit(100) - penalty, F.lit(0))
