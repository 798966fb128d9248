"""Extraction of symbols, imports and patterns from source text, and merging of competing extractors (F4)."""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.naming import segmented_convention
from lodestrata.operators import rules
from lodestrata.operators.pattern_search import spans

#: Confidence tiers of extractors.
TIERS = {"regex": 0.5, "generic": 0.6, "partial": 0.7, "basic": 0.8, "rich": 0.9, "lsp": 0.95}
#: Confidences of concepts found by expression.
CLASS_CONFIDENCE, FUNCTION_CONFIDENCE, CONSTANT_CONFIDENCE = 0.9, 0.85, 0.8
MIN_CONFIDENCE = 0.5

CLASS_RULE = r"class\s+(\w+)\s*(?:\([^)]*\))?\s*:"
FUNCTION_RULE = r"(?m)^([^\n]*?)(?:async\s+)?def\s+(\w+)\s*\([^)]*\)"
CONSTANT_RULE = r"(?m)^([A-Z][A-Z_0-9]+)\s*="


def concepts(files: DataFrame) -> DataFrame:
    """(path, name, concept_type, confidence, n) of classes, functions, methods and constants by expression; n counts repeats.

    A definition that does not begin its line is a method.
    """
    content = F.col("content")
    found = lambda pattern, group: F.regexp_extract_all(content, F.lit(rules.java(pattern)), group)
    typed = lambda names, kind, c: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("concept_type"), F.lit(c).alias("confidence")))
    functions = F.transform(
        F.arrays_zip(found(FUNCTION_RULE, 1).alias("lead"), found(FUNCTION_RULE, 2).alias("name")),
        lambda f: F.struct(f["name"].alias("name"), F.when(f["lead"] == "", "function").otherwise("method").alias("concept_type"), F.lit(FUNCTION_CONFIDENCE).alias("confidence")),
    )
    every = F.concat(typed(found(CLASS_RULE, 1), "class", CLASS_CONFIDENCE), functions, typed(found(CONSTANT_RULE, 1), "constant", CONSTANT_CONFIDENCE))
    return files.select("path", F.inline(every)).groupBy("path", "name", "concept_type", "confidence").agg(F.count(F.lit(1)).alias("n"))


def detected_patterns(files: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(path, pattern_type, confidence, frequency): the best confidence of a type's rules that hit, and all their matches.

    All rules are literals of one projection, so a file is read once and nothing is joined.
    """
    # The counts are a column of their own, so that each rule runs once though two results use it.
    hits = F.array(*[F.regexp_count("content", F.lit(rules.java(pattern))) for _, pattern, _ in rules.DETECTION_RULES])
    by_type: dict[str, list[tuple[Column, float]]] = {}
    for i, (kind, _, confidence) in enumerate(rules.DETECTION_RULES):
        by_type.setdefault(kind, []).append((F.get("hits", i), confidence))
    entries = []
    for kind, counted in by_type.items():
        best = F.greatest(*[F.when(n > 0, c).otherwise(0.0) for n, c in counted], F.lit(0.0))
        entries.append(F.struct(F.lit(kind).alias("pattern_type"), best.alias("confidence"), sum((n for n, _ in counted), F.lit(0)).cast("long").alias("frequency")))
    counted_files = files.select("path", hits.alias("hits"))
    return counted_files.select("path", F.inline(F.filter(F.array(*entries), lambda e: e["confidence"] >= min_confidence)))


def naming_patterns(symbols: DataFrame) -> DataFrame:
    """(path, pattern_type, frequency, confidence) of naming conventions over symbols (path, name, kind)."""
    named = symbols.select("path", segmented_convention(F.col("name"), F.col("kind")).alias("pattern_type")).where("pattern_type IS NOT NULL")
    return named.groupBy("path", "pattern_type").agg(F.count(F.lit(1)).alias("frequency")).withColumn("confidence", F.round(F.least(0.5 + F.col("frequency") * 0.1, F.lit(0.95)), 4))


#: Words in method names that tell repositories and services.
CRUD_WORDS = ("find", "get", "save", "delete", "update", "create", "add", "remove")
SERVICE_WORDS = ("process", "execute", "handle", "perform", "run")
GOD_METHODS, GOD_LINES, LONG_METHOD, VERY_LONG_METHOD = 20, 500, 50, 100


def class_patterns(symbols: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(symbol_id, pattern, confidence) of classes by the evidence in their name, decorators and methods.

    symbols: (symbol_id, path, name, kind, parent, start_line, end_line, decorators). Methods are counted per name of their
    owner before they are joined to it; of classes that share a name in a file, each gets the counts of the name.
    """
    lower = F.lower("name")
    word = lambda words: lower.rlike("|".join(words))
    methods = (
        symbols.where(F.col("kind").isin("method", "constructor", "function") & F.col("parent").isNotNull())
        .groupBy("path", F.trim("parent").alias("owner"))
        .agg(
            F.count(F.lit(1)).alias("n_methods"),
            F.max(lower.isin("instance", "_instance")).alias("has_instance"),
            F.max(lower.isin("get_instance", "getinstance")).alias("has_getter"),
            F.max(F.col("name") == "__new__").alias("has_new"),
            F.max(lower.contains("create")).alias("creates"),
            F.max(lower.contains("make") | lower.contains("build")).alias("makes"),
            F.count_if(word(CRUD_WORDS)).alias("n_crud"),
            F.max(word(SERVICE_WORDS)).alias("serves"),
            F.max(F.col("name").isin("__enter__", "__aenter__")).alias("enters"),
            F.max(F.col("name").isin("__exit__", "__aexit__")).alias("exits"),
        )
    )
    classes = symbols.where(F.col("kind").isin("class", "struct")).select(
        "symbol_id", "path", "name", lower.alias("lower"), (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"),
        F.exists(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: F.lower(d).contains("dataclass")).alias("is_data"),
    )
    joined = classes.join(methods, (classes["path"] == methods["path"]) & (classes["name"] == methods["owner"]), "left").select(classes["symbol_id"], "lower", "n_lines", "is_data", *[c for c in methods.columns if c not in ("path", "owner")])
    weight = lambda cond, w: F.when(F.coalesce(cond, F.lit(False)), w).otherwise(0.0)
    has = F.col("lower").contains
    evidence = {
        "singleton": weight(F.col("has_instance"), 0.3) + weight(F.col("has_getter"), 0.4) + weight(F.col("has_new"), 0.3) + weight(has("singleton"), 0.2),
        "factory": weight(F.col("creates"), 0.4) + weight(F.col("makes"), 0.3) + weight(has("factory"), 0.4),
        "repository": weight(F.col("n_crud") >= 2, 0.4) + weight(has("repo"), 0.5) + weight(has("dao"), 0.4),
        "service": weight(has("service"), 0.6) + weight(F.col("serves"), 0.3),
        "context_manager": weight(F.col("enters"), 0.5) + weight(F.col("exits"), 0.5),
        "dataclass": weight(F.col("is_data"), 1.0),
        "god_class": weight(F.col("n_methods") > GOD_METHODS, 0.4) + weight(F.col("n_lines") > GOD_LINES, 0.4),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("pattern"), F.round(F.least(v, F.lit(1.0)), 4).alias("confidence")) for k, v in evidence.items()])
    return joined.select("symbol_id", F.inline(F.filter(entries, lambda e: e["confidence"] >= min_confidence)))


def decorator_patterns(symbols: DataFrame) -> DataFrame:
    """(symbol_id, pattern, confidence) of symbols by a decorator that says it outright: property and dataclass."""
    plain = F.regexp_replace(F.col("d"), r"^@", "")
    kind = F.when(plain == "property", "property_pattern").when(plain.isin("dataclass", "dataclasses.dataclass"), "dataclass")
    return symbols.select("symbol_id", F.explode("decorators").alias("d")).select("symbol_id", kind.alias("pattern"), F.lit(1.0).alias("confidence")).where("pattern IS NOT NULL").distinct()


def function_patterns(symbols: DataFrame) -> DataFrame:
    """(symbol_id, pattern, confidence): async functions and long ones."""
    length = F.col("end_line") - F.col("start_line") + 1
    entries = F.array(
        F.when(F.col("is_async"), F.struct(F.lit("async_pattern").alias("pattern"), F.lit(0.9).alias("confidence"))),
        F.when(length > LONG_METHOD, F.struct(F.lit("long_method").alias("pattern"), F.when(length >= VERY_LONG_METHOD, 0.9).otherwise(0.7).alias("confidence"))),
    )
    return symbols.where(F.col("kind").isin("function", "method", "constructor")).select("symbol_id", F.inline(F.array_compact(entries)))


_FROM = r"\s+from\s*['\"]([^'\"]+)['\"]"
_SCRIPT_IMPORTS = (
    ("import", r"(?m)^\s*import\s+(?:\{[^}]*\}|[\w$]+(?:\s*,\s*(?:\{[^}]*\}|\*\s+as\s+[\w$]+))?|\*\s+as\s+[\w$]+)" + _FROM, None),
    ("type_only", r"(?m)^\s*import\s+type\s+(?:\{[^}]*\}|[\w$]+|\*\s+as\s+[\w$]+)" + _FROM, None),
    ("import", r"(?m)^\s*import\s*['\"]([^'\"]+)['\"]", None),
    ("require", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)", None),
    ("dynamic", r"\bimport\(\s*['\"]([^'\"]+)['\"]\s*\)", None),
)
#: Import lines of each language: kind, pattern of the module or of a list of modules, pattern of the modules in such a list.
IMPORT_RULES = (
    ("python", "from_import", r"(?m)^from\s+([\w.]+)\s+import\s+[^*\s]", None),
    ("python", "star_import", r"(?m)^from\s+([\w.]+)\s+import\s*\*", None),
    ("python", "import", r"(?m)^import\s+([^\n\r#;]+)", r"(?:^|,)\s*([\w.]+)"),
    *((language, *rule) for language in ("typescript", "javascript") for rule in _SCRIPT_IMPORTS),
    ("go", "import", r"(?m)^import\s+(?:[\w.]+\s+)?\"([^\"]+)\"", None),
    ("go", "import", r"(?m)^import\s*\(([^)]*)\)", r"\"([^\"]+)\""),
    ("java", "import", r"(?m)^import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;", None),
    ("rust", "import", r"(?m)^\s*(?:pub\s+)?use\s+((?:\w+::)*\w+)", None),
)


def is_standard(language: Column, module: Column, is_relative: Column) -> Column:
    """Whether a Python module belongs to the standard library, by its first part; false for other languages."""
    return (language == "python") & ~is_relative & F.regexp_extract(module, r"^[^.]*", 0).isin(*sorted(sys.stdlib_module_names))


def imports(files: DataFrame) -> DataFrame:
    """(path, language, kind, module, is_relative, relative_level, is_stdlib) of every import line by expression; files: (path, language, content).

    Python modules lose their leading dots, which become the level; './' and '../' of scripts become levels too.
    """
    def entry(lang: str, kind: str, pattern: str, inner: str | None) -> Column:
        found = F.when(F.col("language") == lang, F.regexp_extract_all("content", F.lit(rules.java(pattern)), 1)).otherwise(F.array().cast("array<string>"))
        if inner:
            found = F.flatten(F.transform(found, lambda group: F.regexp_extract_all(group, F.lit(rules.java(inner)), 1)))
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("rule_kind"), m.alias("raw")))

    entries = [entry(*rule) for rule in IMPORT_RULES]
    raw = F.col("raw")
    dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    script = F.col("language").isin("typescript", "javascript") & raw.startswith(".")
    level = F.when((F.col("language") == "python") & (dots > 0), dots).when(script, 1 + F.regexp_count(raw, F.lit(r"\.\./"))).otherwise(0)
    module = F.when(script, F.translate(F.regexp_replace(raw, r"^(?:\.{1,2}/)+", ""), "/", ".")).otherwise(F.regexp_replace(raw, r"^\.+", ""))
    return files.select("path", "language", F.inline(F.concat(*entries))).select(
        "path", "language", F.when(level > 0, "relative").otherwise(F.col("rule_kind")).alias("kind"), module.alias("module"), (level > 0).alias("is_relative"), level.cast("int").alias("relative_level")
    ).withColumn("is_stdlib", is_standard(F.col("language"), F.col("module"), F.col("is_relative")))


def resolve_to_files(found: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``resolved``: the path of the file that a relative import names, null if there is none. found has ``target`` modules."""
    from lodestrata.operators.depgraph import module_of

    known = files.select(module_of(F.col("path")).alias("target"), F.col("path").alias("resolved")).groupBy("target").agg(F.min("resolved").alias("resolved"))
    return found.join(known, "target", "left")


# ---------------------------------------------------------------------------------------------------------------
# Python by its own parser

_SYMBOLS = "path string, name string, kind string, start_line int, end_line int, parent string, qualified_name string, signature string, docstring string, decorators array<string>, is_async boolean, visibility string, error string"


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of Python files by the interpreter's parser, one row each; a file that does not parse gives one row with its error."""

    def visibility(name: str) -> str:
        return "private" if name.startswith("__") and not name.endswith("__") else "protected" if name.startswith("_") else "public"

    def rows_of(path: str, text: str) -> Iterator[tuple]:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError) as error:
            yield (path, None, "error", getattr(error, "lineno", None), None, None, None, None, None, None, None, None, str(error)[:200])
            return
        stack: list[tuple[ast.AST, tuple[str, ...], bool]] = [(tree, (), False)]
        while stack:
            node, outer, in_class = stack.pop()
            for child in reversed(list(ast.iter_child_nodes(node))):
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    stack.append((child, (*outer, child.name), isinstance(child, ast.ClassDef)))
                elif not isinstance(child, ast.expr):
                    stack.append((child, outer, in_class))
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(node, ast.ClassDef)
                parent = outer[-2] if len(outer) > 1 else None
                owner_is_class = getattr(node, "_owner_is_class", False)
                kind = "class" if is_class else "constructor" if node.name == "__init__" and owner_is_class else "method" if owner_is_class else "function"
                if is_class:
                    signature = f"class {node.name}" + (f"({', '.join(ast.unparse(b) for b in node.bases)})" if node.bases else "")
                else:
                    signature = ("async " if isinstance(node, ast.AsyncFunctionDef) else "") + f"def {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
                yield (
                    path, node.name, kind, node.lineno, node.end_lineno, parent, ".".join(outer), signature, ast.get_docstring(node), [ast.unparse(d) for d in node.decorator_list],
                    isinstance(node, ast.AsyncFunctionDef), visibility(node.name), None,
                )
            for child in ast.iter_child_nodes(node):
                child._owner_is_class = isinstance(node, ast.ClassDef)
            if isinstance(node, ast.Module):
                for child in node.body:
                    target = child.targets[0] if isinstance(child, ast.Assign) and len(child.targets) == 1 else child.target if isinstance(child, ast.AnnAssign) else None
                    if isinstance(target, ast.Name) and target.id.isupper():
                        yield (path, target.id, "constant", child.lineno, child.end_lineno, None, target.id, None, None, [], False, visibility(target.id), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, i = pa.string(), pa.int32()
        kinds = [s, s, s, i, i, s, s, s, s, pa.list_(s), pa.bool_(), s, s]
        names = [part.split()[0] for part in _SYMBOLS.split(", ")]
        for batch in batches:
            rows = [r for path, text in zip(*(batch.column(k).to_pylist() for k in range(2))) if text is not None for r in rows_of(path, text)]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return files.where("path LIKE '%.py'").select("path", "content").mapInArrow(run, _SYMBOLS)


def python_imports(files: DataFrame) -> DataFrame:
    """(path, module, name, alias, kind, relative_level, line, is_type_only, is_conditional) by the interpreter's parser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, i, b = pa.string(), pa.int32(), pa.bool_()
        names = ["path", "module", "name", "alias", "kind", "relative_level", "line", "is_type_only", "is_conditional"]
        for batch in batches:
            rows = []
            for path, text in zip(*(batch.column(k).to_pylist() for k in range(2))):
                try:
                    with warnings.catch_warnings():
                        warnings.simplefilter("ignore")
                        tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                stack: list[tuple[ast.AST, bool, bool]] = [(tree, False, False)]
                while stack:
                    node, type_only, conditional = stack.pop()
                    if isinstance(node, ast.Import):
                        rows.extend((path, a.name, None, a.asname, "import_alias" if a.asname else "import", 0, node.lineno, type_only, conditional) for a in node.names)
                    elif isinstance(node, ast.ImportFrom):
                        for a in node.names:
                            kind = "star_import" if a.name == "*" else "relative" if node.level else "from_import"
                            rows.append((path, node.module or "", a.name, a.asname, kind, node.level, node.lineno, type_only, conditional))
                    checking = isinstance(node, ast.If) and "TYPE_CHECKING" in ast.unparse(node.test)
                    branch = isinstance(node, (ast.If, ast.Try))
                    stack.extend((child, type_only or checking, conditional or branch) for child in ast.iter_child_nodes(node) if not isinstance(child, ast.expr))
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [s, s, s, s, s, i, i, b, b])], names)

    return files.where("path LIKE '%.py'").select("path", "content").mapInArrow(run, "path string, module string, name string, alias string, kind string, relative_level int, line int, is_type_only boolean, is_conditional boolean")


def rule_spans(files: DataFrame) -> DataFrame:
    """All matches of the built-in rules with their places (``pattern_search.spans``)."""
    return spans(files, [(name, lang, pattern) for name, lang, pattern, _ in rules.SEARCH_RULES])


# ---------------------------------------------------------------------------------------------------------------
# Merging of backends; every frame has ``priority`` (greater first)

def merge_symbols(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """primary and those constants of secondary whose name primary has not in that file; repeated names count once."""
    extra = secondary.where("kind = 'constant'").join(primary.select("path", "name").distinct(), ["path", "name"], "left_anti")
    first = Window.partitionBy("path", "name").orderBy("start_line")
    extra = extra.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return primary.unionByName(extra.select(*primary.columns))


def merge_patterns(patterns: DataFrame) -> DataFrame:
    """Per path and type the pattern of the greatest confidence, then the most evidence, then the highest priority."""
    best = F.max_by(F.struct(*patterns.columns), F.struct("confidence", "n_evidence", "priority"))
    return patterns.groupBy(F.col("path").alias("_p"), F.col("pattern_type").alias("_k")).agg(best.alias("r")).select("r.*")


def best_imports(found: DataFrame) -> DataFrame:
    """Per path the imports of the backend with the highest priority that found any."""
    top = found.groupBy("path").agg(F.max("priority").alias("priority"))
    return found.join(top, ["path", "priority"], "left_semi")


def merge_frameworks(found: DataFrame) -> DataFrame:
    """Per name the entry of the highest priority."""
    return found.groupBy("framework").agg(F.max_by(F.struct(*[c for c in found.columns if c != "framework"]), "priority").alias("r")).select("framework", "r.*")
