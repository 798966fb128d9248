"""Syntax trees as rows, and queries over them.

A tree is a relation of nodes, so a query is a filter with joins of nodes to their parents. Python is read by the interpreter's
parser; JavaScript, TypeScript, Java and Go by a reader of blocks, which gives their declarations. A file that cannot be
parsed has one node of the type ERROR. Nodes: (path, language, node, parent, type, field, text, start_line, start_column, end_line, end_column);
lines and columns are 1-based, parent is null for a file's root, field is the node's place in its parent, text a leaf's text.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODES = "path string, language string, node int, parent int, type string, field string, text string, start_line int, start_column int, end_line int, end_column int"
#: Names of the node types that have one of their own in queries; others are their class's name in lower case with underscores.
PYTHON_TYPES = {
    "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Import": "import_statement", "ImportFrom": "import_from_statement",
    "Name": "identifier", "Assign": "assignment", "AnnAssign": "assignment", "If": "if_statement", "For": "for_statement", "While": "while_statement", "Try": "try_statement", "With": "with_statement", "Return": "return_statement",
}
#: Fields of definitions that queries name.
_FIELDS = {"args": "parameters", "bases": "superclasses", "decorator_list": "decorator"}
_LINES = re.compile(r"\r\n|\r|\n")


class _Rows:
    def __init__(self, path: str, language: str):
        self.path, self.language, self.rows = path, language, []

    def add(self, parent: int | None, kind: str, field: str | None, text: str | None, place: tuple[int | None, int | None, int | None, int | None]) -> int:
        number = len(self.rows)
        self.rows.append((self.path, self.language, number, parent, kind, field, text, *place))
        return number


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()


def _python_nodes(path: str, text: str) -> list[tuple]:
    rows = _Rows(path, "python")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        line = getattr(error, "lineno", None)
        rows.add(None, "ERROR", None, str(error)[:200], (line, getattr(error, "offset", None), line, None))
        return rows.rows
    stack: list[tuple[ast.AST, int | None, str | None]] = [(tree, None, None)]
    while stack:
        node, parent, field = stack.pop()
        if isinstance(node, (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)):
            continue
        name = type(node).__name__
        start = getattr(node, "lineno", None)
        place = (start, node.col_offset + 1, node.end_lineno, node.end_col_offset + 1) if start else (None, None, None, None)
        if field == "decorator" and parent is not None:
            parent = rows.add(parent, "decorator", "decorator", None, place)
            field = None
        text_of = node.id if isinstance(node, ast.Name) else node.arg if isinstance(node, (ast.arg, ast.keyword)) else node.attr if isinstance(node, ast.Attribute) else None
        number = rows.add(parent, PYTHON_TYPES.get(name, _snake(name)), field, text_of, place)
        if isinstance(node, ast.AsyncFunctionDef):
            rows.add(number, "async", None, "async", place)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            rows.add(number, "identifier", "name", node.name, place)
        elif isinstance(node, ast.Import):
            for alias in node.names:
                rows.add(number, "dotted_name", "name", alias.name, place)
        elif isinstance(node, ast.ImportFrom):
            rows.add(number, "dotted_name", "module_name", "." * node.level + (node.module or ""), place)
        for child_field, value in reversed(list(ast.iter_fields(node))):
            for child in reversed(value if isinstance(value, list) else [value]):
                if isinstance(child, ast.AST):
                    stack.append((child, number, _FIELDS.get(child_field, child_field)))
    return rows.rows


# ---------------------------------------------------------------------------------------------------------------
# Declarations of languages with blocks

_COMMENT = r"//[^\n\r]*|/\*[\s\S]*?(?:\*/|$)"
_TEXTS = {
    "javascript": r"\"(?:[^\"\\\n\r]|\\[\s\S])*\"|'(?:[^'\\\n\r]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`|(?<=[(,=:\[!&|?;])\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n\r])*\]|[^/\\\n\r\[])+/",
    "java": r"\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n\r]|\\.)*\"|'(?:[^'\\\n\r]|\\.)*'",
    "go": r"\"(?:[^\"\\\n\r]|\\.)*\"|'(?:[^'\\\n\r]|\\.)*'|`[^`]*`",
}
_TEXTS["typescript"] = _TEXTS["javascript"]
_SCAN = {language: re.compile(rf"({_COMMENT})|({texts})|([{{}}()\[\];])") for language, texts in _TEXTS.items()}
_PARTNER = {")": "(", "]": "[", "}": "{"}
_NO_NAME = frozenset("if for while switch catch with else do try finally return throw new function synchronized typeof await yield case func select go defer".split())
_TAIL = r"\s*(?:throws\s+[\w.,\s]+|:[\s\S]+)?$"
_METHOD = re.compile(r"([\w$#]+)\s*(?:<[^()]*>)?\s*\x01" + _TAIL)
_ARROW = re.compile(r"(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b\s*\*?\s*\x01?|\x01|[\w$]+)\s*(?::[^=]+?)?(?:=>)?\s*$")
_HEADS = {
    "javascript": (("class_declaration", re.compile(r"\bclass\s+([\w$]+)")), ("function_declaration", re.compile(r"\bfunction\s*\*?\s*([\w$]+)\s*(?:<[^()]*>)?\s*\x01"))),
    "typescript": (
        ("interface_declaration", re.compile(r"\binterface\s+([\w$]+)")), ("enum_declaration", re.compile(r"\benum\s+([\w$]+)")), ("internal_module", re.compile(r"\b(?:namespace|module)\s+([\w$.]+)")),
        ("class_declaration", re.compile(r"\bclass\s+([\w$]+)")), ("function_declaration", re.compile(r"\bfunction\s*\*?\s*([\w$]+)\s*(?:<[^()]*>)?\s*\x01")),
    ),
    "java": (
        ("interface_declaration", re.compile(r"\binterface\s+(\w+)")), ("enum_declaration", re.compile(r"\benum\s+(\w+)")), ("class_declaration", re.compile(r"\bclass\s+(\w+)")), ("record_declaration", re.compile(r"\brecord\s+(\w+)\s*(?:<[^()]*>)?\s*\x01")),
    ),
    "go": (("struct_type", re.compile(r"\btype\s+(\w+)\s*(?:\[[^\]]*\])?\s*struct\s*$")), ("interface_type", re.compile(r"\btype\s+(\w+)\s*(?:\[[^\]]*\])?\s*interface\s*$"))),
}
_GO_FUNCTION = re.compile(r"\bfunc\s*(\x01\s*)?(\w+)\s*(?:\[[^\]]*\])?\s*\x01")
_OWNERS = frozenset(("class_declaration", "interface_declaration", "enum_declaration", "record_declaration"))
#: Kinds of symbols by node type.
SYMBOL_KINDS = {
    "class_declaration": "class", "interface_declaration": "interface", "enum_declaration": "enum", "record_declaration": "class", "internal_module": "namespace", "struct_type": "struct", "interface_type": "interface",
    "function_declaration": "function", "arrow_function": "function", "method_definition": "method", "method_declaration": "method", "constructor_declaration": "constructor", "class_definition": "class", "function_definition": "function",
}


@dataclass
class _Block:
    bracket: str
    head: list[str]
    since: int
    node: int | None = None
    kind: str = ""
    name: str = ""


def _declared(head: str, language: str, owner: _Block) -> tuple[str, str] | None:
    """(node type, name) of the declaration whose head stands before a block; groups in it are one sign."""
    if language == "go":
        found = _GO_FUNCTION.search(head)
        if found:
            return ("method_declaration" if found.group(1) else "function_declaration"), found.group(2)
    for kind, pattern in _HEADS[language]:
        found = pattern.search(head)
        if found:
            return kind, found.group(1)
    if language == "go":
        return None
    found = _METHOD.search(head)
    if found and found.group(1) not in _NO_NAME and owner.kind in _OWNERS and not re.search(r"\b(?:new|return)\s+[\w$.]+\s*\x01$", head.rstrip()):
        name = found.group(1)
        if language == "java":
            return ("constructor_declaration" if name == owner.name else "method_declaration"), name
        return "method_definition", name
    found = _ARROW.search(head) if language != "java" else None
    return ("arrow_function", found.group(1)) if found else None


def _block_nodes(path: str, text: str, language: str) -> list[tuple]:
    rows = _Rows(path, language)
    starts = [0, *(m.end() for m in _LINES.finditer(text))]
    line_of = lambda at: bisect_right(starts, at)
    column_of = lambda at: at - starts[line_of(at) - 1] + 1
    end_line = line_of(max(0, len(text) - 1))
    root = rows.add(None, "program", None, None, (1, 1, end_line, len(text) - starts[end_line - 1] + 1))
    stack = [_Block("", [], 0, root)]
    at, first, broken = 0, -1, None

    def take(upto: int) -> None:
        nonlocal first
        piece = text[at:upto]
        if language == "go" and "\n" in piece:
            # Line ends end statements there; the head of a block stands on one line, groups aside.
            stack[-1].head, first = [], -1
            cut = piece.rfind("\n") + 1
            if piece[cut:].strip():
                first = at + cut + len(piece[cut:]) - len(piece[cut:].lstrip())
            piece = piece[cut:]
        elif piece.strip() and first < 0:
            first = at + len(piece) - len(piece.lstrip())
        stack[-1].head.append(piece)

    firsts = [-1]
    for match in _SCAN[language].finditer(text):
        first = firsts[-1]
        take(match.start())
        firsts[-1] = first
        at = match.end()
        comment, literal, sign = match.groups()
        if comment:
            stack[-1].head.append("\n")
            continue
        if literal:
            stack[-1].head.append('""')
            if firsts[-1] < 0:
                firsts[-1] = match.start()
            continue
        top = stack[-1]
        if sign == ";":
            top.head, firsts[-1] = [], -1
        elif sign in "([{":
            block = _Block(sign, [], match.start())
            if sign == "{" and top.bracket in ("", "{"):
                found = _declared("".join(top.head), language, top)
                if found:
                    begin = firsts[-1] if firsts[-1] >= 0 else match.start()
                    parent = next((b.node for b in reversed(stack) if b.node is not None), root)
                    block.kind, block.name = found
                    block.node = rows.add(parent, found[0], None, None, (line_of(begin), column_of(begin), None, None))
                    rows.add(block.node, "identifier", "name", found[1], (line_of(begin), column_of(begin), line_of(begin), None))
            stack.append(block)
            firsts.append(-1)
        else:
            if stack[-1].bracket != _PARTNER[sign]:
                broken = match.start()
                break
            closed = stack.pop()
            firsts.pop()
            if closed.node is not None:
                old = rows.rows[closed.node]
                rows.rows[closed.node] = (*old[:9], line_of(match.start()), column_of(match.start()) + 1)
            if sign == "}" and stack[-1].bracket in ("", "{"):
                declared = "".join(stack[-1].head).rstrip().endswith(("=", ",", ":", "(", "return"))
                if not declared:
                    stack[-1].head, firsts[-1] = [], -1
                else:
                    stack[-1].head.append("\x02")
            else:
                stack[-1].head.append("\x01" if sign == ")" else "[]")
    if broken is not None or len(stack) > 1:
        spot = broken if broken is not None else stack[-1].since
        rows.add(root, "ERROR", None, text[spot : spot + 1], (line_of(spot), column_of(spot), line_of(spot), column_of(spot) + 1))
        # Nodes that were never closed reach to the text's end.
        for block in stack[1:]:
            if block.node is not None:
                rows.rows[block.node] = (*rows.rows[block.node][:9], end_line, None)
    return rows.rows


def nodes(files: DataFrame) -> DataFrame:
    """The nodes of files (path, language, content) in Python, JavaScript, TypeScript, Java and Go; null contents and others have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        string, number = pa.string(), pa.int32()
        kinds = [string, string, number, number, string, string, string, number, number, number, number]
        names = [part.split()[0] for part in NODES.split(", ")]
        for batch in batches:
            rows = []
            for path, language, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if text is not None:
                    rows.extend(_python_nodes(path, text) if language == "python" else _block_nodes(path, text, language))
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return files.where(F.col("language").isin("python", *_SCAN)).select("path", "language", "content").mapInArrow(run, NODES)


def find(tree: DataFrame, *types: str) -> DataFrame:
    return tree.where(F.col("type").isin(*types))


def diagnostics(tree: DataFrame) -> DataFrame:
    """(path, language, line, message, severity) of what does not parse."""
    return tree.where("type = 'ERROR'").select("path", "language", F.col("start_line").alias("line"), F.col("text").alias("message"), F.lit("error").alias("severity"))


def symbols(tree: DataFrame) -> DataFrame:
    """(path, language, name, kind, start_line, end_line, parent) of the declarations; parent is the name of the one around.

    Functions of Python are methods or constructors where a class is their parent.
    """
    named = tree.where("field = 'name' AND type = 'identifier'").select("path", F.col("parent").alias("node"), F.col("text").alias("name"))
    kinds = F.create_map(*[F.lit(x) for pair in SYMBOL_KINDS.items() for x in pair])
    declared = tree.select("path", "language", "node", "parent", "type", "start_line", "end_line").where(F.col("type").isin(*SYMBOL_KINDS)).join(named, ["path", "node"])
    around = declared.select("path", F.col("node").alias("parent"), F.col("name").alias("owner"), F.col("type").alias("owner_type"))
    joined = declared.join(around, ["path", "parent"], "left")
    in_class = F.coalesce(F.col("owner_type") == "class_definition", F.lit(False))
    python = F.when(in_class & (F.col("name") == "__init__"), "constructor").when(in_class, "method").otherwise("function")
    script = F.when(F.col("name") == "constructor", "constructor").otherwise("method")
    kind = F.when(F.col("type") == "function_definition", python).when(F.col("type") == "method_definition", script).otherwise(kinds[F.col("type")])
    return joined.select("path", "language", "name", kind.alias("kind"), "start_line", "end_line", F.col("owner").alias("parent"))


def parameters(tree: DataFrame) -> DataFrame:
    """(path, function, start_line, place, name) of the named parameters of Python functions, in the order of the text."""
    functions = tree.where("type = 'function_definition'").select("path", F.col("node").alias("f"), "start_line")
    names = tree.where("field = 'name' AND type = 'identifier'").select("path", F.col("parent").alias("f"), F.col("text").alias("function"))
    lists = tree.where("type = 'arguments' AND field = 'parameters'").select("path", F.col("parent").alias("f"), F.col("node").alias("arguments"))
    found = tree.where("type = 'arg'").select("path", F.col("parent").alias("arguments"), F.col("text").alias("name"), F.struct("start_line", "start_column").alias("at"))
    joined = found.join(lists, ["path", "arguments"]).join(functions, ["path", "f"]).join(names, ["path", "f"])
    place = F.row_number().over(Window.partitionBy("path", "f").orderBy("at"))
    return joined.select("path", "function", "start_line", place.alias("place"), "name")


# ---------------------------------------------------------------------------------------------------------------
# Queries

@dataclass(frozen=True)
class Pattern:
    """A node of a query: its type ('_' is any), the field it stands in, its captures and the patterns of children."""

    kind: str
    field: str | None = None
    captures: tuple[str, ...] = ()
    children: tuple["Pattern", ...] = ()
    optional: bool = False


_WORDS = re.compile(r"\s*([()\[\]?]|@[\w.-]+|[\w-]+:|[\w-]+)")


def parse_query(text: str) -> list[Pattern]:
    """The alternatives of a query such as ``(function_definition name: (identifier) @name) @function``.

    Known are types, fields, captures, alternatives in brackets and optional children. Anything else raises ValueError.
    """
    words, at = [], 0
    while at < len(text.rstrip()):
        found = _WORDS.match(text, at)
        if not found:
            raise ValueError(f"cannot read the query at {text[at:at + 20]!r}")
        words.append(found.group(1))
        at = found.end()
    words.append("")
    place = 0

    def pattern(field: str | None) -> Pattern:
        nonlocal place
        if words[place] != "(":
            raise ValueError("a node begins with a parenthesis")
        kind = words[place + 1]
        place += 2
        children = []
        while words[place] != ")":
            inner = None
            if words[place].endswith(":"):
                inner = words[place][:-1]
                place += 1
            if not words[place]:
                raise ValueError("the query ends too early")
            children.append(pattern(inner))
        place += 1
        optional = words[place] == "?"
        place += optional
        captures = []
        while words[place].startswith("@"):
            captures.append(words[place][1:])
            place += 1
        return Pattern(kind, field, tuple(captures), tuple(children), optional)

    if words[0] == "[":
        place, out = 1, []
        while words[place] != "]":
            out.append(pattern(None))
        place += 1
    else:
        out = [pattern(None)]
    if words[place]:
        raise ValueError("something follows the query")
    return out


#: Built-in queries: name, language, text.
QUERIES = (
    ("function_def", "python", "(function_definition name: (identifier) @name parameters: (arguments) @params) @function"),
    ("async_function", "python", "(function_definition (async) @async_keyword name: (identifier) @name) @async_func"),
    ("class_def", "python", "(class_definition name: (identifier) @name) @class"),
    ("decorator", "python", "(decorator (identifier) @decorator_name) @decorator"),
    ("import", "python", "[(import_statement name: (dotted_name) @module) @import (import_from_statement module_name: (dotted_name) @module) @from_import]"),
    ("function_def", "javascript", "[(function_declaration name: (identifier) @name) @function (arrow_function) @arrow (method_definition name: (identifier) @name) @method]"),
    ("class_def", "javascript", "(class_declaration name: (identifier) @name) @class"),
    ("interface_def", "typescript", "(interface_declaration name: (identifier) @name) @interface"),
    ("enum_def", "typescript", "(enum_declaration name: (identifier) @name) @enum"),
    ("function_def", "go", "(function_declaration name: (identifier) @name) @function"),
    ("method_def", "go", "(method_declaration name: (identifier) @name) @method"),
    ("struct_def", "go", "(struct_type name: (identifier) @name) @struct"),
    ("interface_def", "go", "(interface_type name: (identifier) @name) @interface"),
)


def _matches(tree: DataFrame, pattern: Pattern) -> DataFrame:
    """(path, node, captures) of the nodes that fit; captures is a list of (capture, node). Several children give several matches."""
    fits = tree if pattern.kind == "_" else tree.where(F.col("type") == pattern.kind)
    if pattern.field:
        fits = fits.where(F.col("field") == pattern.field)
    own = F.array(*[F.struct(F.lit(c).alias("capture"), F.col("node").alias("node")) for c in pattern.captures]) if pattern.captures else F.array().cast("array<struct<capture: string, node: int>>")
    out = fits.select("path", "node", "parent", own.alias("captures"))
    for child in pattern.children:
        below = _matches(tree, child).select("path", F.col("parent").alias("node"), F.col("captures").alias("more"))
        out = out.join(below, ["path", "node"], "left" if child.optional else "inner").withColumn("captures", F.concat("captures", F.coalesce("more", F.array().cast("array<struct<capture: string, node: int>>")))).drop("more")
    return out


def match(tree: DataFrame, name: str, language: str, query: str) -> DataFrame:
    """(path, pattern, type, text, line_start, line_end, column_start, column_end): a row per capture, named ``name:capture``.

    Captures that begin with an underscore are left out.
    """
    own = tree.where(F.col("language") == language)
    found = None
    for pattern in parse_query(query):
        part = _matches(own, pattern).select("path", F.explode("captures").alias("c"))
        found = part if found is None else found.unionByName(part)
    wanted = found.select("path", "c.node", "c.capture").where(~F.col("capture").startswith("_")).distinct()
    return wanted.join(own, ["path", "node"]).select(
        "path", F.concat(F.lit(name + ":"), F.col("capture")).alias("pattern"), "type", "text", F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"),
        F.col("start_column").alias("column_start"), F.col("end_column").alias("column_end"),
    )


def search(tree: DataFrame, query: str) -> DataFrame:
    """The matches of the built-in queries whose name holds the text, whatever its case."""
    chosen = [rule for rule in QUERIES if query.lower() in rule[0].lower()]
    out = None
    for rule in chosen:
        part = match(tree, *rule)
        out = part if out is None else out.unionByName(part)
    return match(tree.limit(0), *QUERIES[0]) if out is None else out
