"""Functions paired with their documentation (problem 1).

Method: functions are extracted from the files, broken ones too, by generalised LL grammars with graph-structured stacks and
error recovery (``functions``), each with the comment that is attached to it; declarations without a body are read by a
grammar over classes of lines. Documentation that says nothing is dropped: by what is left when the function's own words,
tags, headings and directives are taken away. What may be a template (text about documentation or work that is still to
be done, or that looks like a directive) is decided by the corpus: it is dropped if the hash of its template, the function's
own words masked, is counted for several functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.gll import Grammar, Parse
from lodestrata.llm.lexing import TOKENS
from lodestrata.session import durable

#: Line classes: c line comment, k block comment of one line, s/m/e its start, middle and end, d decorator, b blank, h the
#: function's first line, o other.
COMMENT_GRAMMAR: Grammar = {
    "unit": (("water", "function"), ("function",)),
    "water": (("*",), ("*", "water")),
    "function": (("doc", "decorators", "h"), ("decorators", "h")),
    "doc": (("run",), ("block",)),
    "run": (("c",), ("c", "run")),
    "block": (("k",), ("s", "middle", "e")),
    "middle": ((), ("m", "middle")),
    "decorators": ((), ("d", "decorators")),
}
#: Token classes: d the head's words, brackets, : colons, n line end, s string, x other.
BODY_GRAMMAR: Grammar = {
    "function": (("d", "items", ":", "suite"),),
    "items": ((), ("item", "items")),
    "item": (("x",), ("group",)),
    "group": (("(", "inner", ")"), ("[", "inner", "]"), ("{", "inner", "}")),
    "inner": ((), ("part", "inner")),
    "part": (("x",), ("group",)),
    "suite": (("doc",), ("n", "doc")),
    "doc": (("s",),),
}

_LINES = re.compile(r"\r\n|\r|\n")


@lru_cache(maxsize=200_000)
def _comment_span(classes: str) -> tuple[int, int] | None:
    """Lines [from, to) of the comment that the function's line, the last class, has above it."""
    parse = Parse(COMMENT_GRAMMAR, classes, "unit")
    heads = [start for start, end in parse.spans("function") if end == len(classes)]
    best: tuple[int, int] | None = None
    for start, end in parse.spans("doc"):
        if start in heads and len(classes) - 1 in parse.ends[("decorators", end)]:
            # A run of line comments is taken whole; of a block comment there is one reading.
            if best is None or start < best[0]:
                best = (start, end)
    return best


@lru_cache(maxsize=200_000)
def _body_string(classes: str) -> int | None:
    """Index of the token that is the string at the body's start."""
    parse = Parse(BODY_GRAMMAR, classes, "function")
    docs = [start for start, end in parse.spans("doc") if end in parse.ends[("function", 0)]]
    return max(docs) if docs else None


def _line_class(line: str, in_block: bool) -> str:
    """Class of a line that is read upwards: in_block says that the line below belongs to a block comment's inside."""
    text = line.strip()
    if in_block:
        return "s" if text.startswith("/*") else "m"
    if not text:
        return "b"
    if text.startswith("//"):
        return "c"
    if text.endswith("*/"):
        return "k" if text.startswith("/*") else "e" if text.startswith("*") or "/*" not in text else "o"
    if text.startswith("@") and not text.endswith(("{", ";")):
        return "d"
    return "o"


def comment_above(lines: list[str], index: int) -> str | None:
    """The comment directly above line ``index``, with its signs; decorators may stand between."""
    classes = ["h"]
    at, in_block = index - 1, False
    while at >= 0:
        kind = _line_class(lines[at], in_block)
        if kind in "bo":
            break
        classes.append(kind)
        in_block = kind in "em"
        at -= 1
    classes.reverse()
    # Runs of equal classes are one token; starts gives each token's first line.
    runs, starts = [], []
    for k, kind in enumerate(classes):
        if not runs or runs[-1] != kind or kind not in "cmd":
            runs.append(kind)
            starts.append(k)
    span = _comment_span("".join(runs))
    if span is None:
        return None
    first = index - len(classes) + 1
    return "\n".join(lines[first + starts[span[0]] : first + starts[span[1]]])


_HEAD_WORDS = frozenset(("def", "async"))


def string_in_body(text: str, offset: int) -> str | None:
    """The string that opens the body of the Python function whose head begins at the offset."""
    classes: list[str] = []
    words: list[str] = []
    depth, ended = 0, False
    for match in TOKENS["py"].finditer(text, offset):
        token = match.group(1)
        if not token:
            break
        c = token[0]
        if c in "\n\r":
            if depth > 0:
                continue
            if ended or not classes:
                if classes and classes[-1] != "n":
                    classes.append("n")
                    words.append(token)
                continue
            return None
        if token in _HEAD_WORDS:
            kind = "x" if classes else "d"
            if len(classes) == 1 and classes[0] == "d":
                continue
        elif c in "([{":
            kind, depth = c, depth + 1
        elif c in ")]}":
            kind, depth = c, depth - 1
        elif token == ":" and depth <= 0:
            kind = ":"
        elif token[-1] in "\"'" and len(token) > 1:
            kind = "s"
        else:
            kind = "x"
        # Runs of plain tokens count as one, so the class string is short for heads of any length.
        if ended or kind not in "xs" or classes[-1:] != ["x"]:
            classes.append("x" if kind == "s" and not ended else kind)
            words.append(token)
        if ended:
            break
        ended = kind == ":" and depth <= 0
    if classes[:1] != ["d"]:
        return None
    found = _body_string("".join(classes))
    if found is None:
        return None
    literal = words[found]
    return None if literal[:1] in "bBfF" or literal[1:2] in ("b", "B", "f", "F") and literal[0] in "rR" else literal


def attached(text: str, lang: str, lines: list[int]) -> list[tuple[int, str | None]]:
    """(line, comment or None) of the functions that begin, or whose decorators begin, at the 1-based lines."""
    from lodestrata.llm.functions import functions_of

    docs = {line: f.doc for f in functions_of(text, lang, check=False)[0] for line in range(f.first, f.line + 1)}
    parts = _LINES.split(text)
    # A line where no whole function begins may hold a declaration or the head of one that was cut off.
    above = lambda line: comment_above(parts, line - 1) if lang != "py" and 0 < line <= len(parts) else None
    return [(line, docs[line] if line in docs else above(line)) for line in lines]


# ---------------------------------------------------------------------------------------------------------------
# What says nothing

_SIGNS = re.compile(r"^\s*(?:/\*+|\*+/|\*+(?!/)|//+|#+|--+)?\s?|\s*\*+/\s*$")
_QUOTES = re.compile(r"^\s*[rRuU]?(?:\"\"\"|'''|\"|')|(?:\"\"\"|'''|\"|')\s*$")

#: Directives to tools.
_DIRECTIVE = re.compile(
    r"(?:noqa|nolint|nosec|nosonar|pylint|flake8|mypy|pyright|ruff|isort|black|fmt|yapf|type\s*:\s*ignore|pragma|eslint|tslint|jshint|jslint|prettier|stylelint|biome|istanbul|c8|@ts-|ts-ignore|"
    r"@?suppresswarnings|checkstyle|clang-format|clang-tidy|cspell|codespell|spell-?checker|go:|\+build|lint:|golint|revive|coverage|v8 ignore|webpack|@formatter|sonar|noinspection|region|endregion)"
    r"(?:\b|[:\-])",
    re.IGNORECASE,
)
#: Words after a tool's name that make the line a directive; so do signs and at most three words without a full stop.
_ORDERS = frozenset("disable enable ignore off on skip next start end no all".split())
#: Marks of work to be done. With a sign the whole line is about the work, else it may be.
_TO_DO = re.compile(r"^\W*(?:todo|fixme|xxx|hack|tbd|wip)\b(?:\s*\([^)]*\))?\s*(?:[^\w\s].*)?$", re.IGNORECASE)
_MAY_BE_TO_DO = re.compile(r"^\W*(?:todo|fixme|xxx|hack|tbd|wip)\b", re.IGNORECASE)
#: Words that speak about documentation, or stand where it is missing.
META_WORDS = frozenset(
    """
    documentation documented document documents doc docs docstring docstrings undocumented describe described description descriptions comment comments placeholder stub stubs tbd tba todo fixme
    xxx na none nil nothing missing pending soon coming later follows follow goes here insert add write written fill filled empty text auto autogenerated generated inheritdoc inherit inherited see overview summary
    provided available needed required please be to is was no not yet any your the a an this that of in for it and or will should must on by with method function class constructor header lorem ipsum dolor sit amet
    dokumentation dokumentiert beschreibung folgt fehlt kommentar keine noch nicht später ausstehend hier einfügen
    documentation documenter documentée description à a venir manquante commentaire aucune pas encore compléter
    documentación documentar descripción pendiente falta comentario sin ninguna por todavía añadir aquí
    """.split()
)
#: Without one of these, text out of META_WORDS alone may still be a remark.
_CORE_META = frozenset(
    """
    documentation documented document doc docs docstring undocumented describe description comment placeholder stub tbd tba todo fixme xxx na none inheritdoc generated autogenerated
    dokumentation dokumentiert beschreibung kommentar documenter documentée commentaire documentación documentar descripción comentario
    """.split()
)
#: Words that add nothing to a function's own words.
_EMPTY_WORDS = frozenset(
    """
    the a an this that these it its is are be of for to in on with and or by as from at into self cls me my our function functions func fn method methods member procedure routine subroutine constructor ctor
    class object instance def async static public private protected void new getter setter accessor helper main simple just does do doing performs perform executes execute runs handles handle implements implementation
    param params parameter parameters arg args argument arguments return returns returned yields yield raises throws value values result results type types kwargs optional default input output exception see note notes example examples
    die der das den dem des eine ein einer einen funktion methode konstruktor la le les un une des du de fonction méthode constructeur el los las una del función método
    """.split()
)
#: Signs that stand for no text.
_NO_TEXT = re.compile(r"^\W*(?:n\W{0,2}a|t\W?b\W?[da]|s\W?o|k\W?a)\W*$", re.IGNORECASE)
_SECTION = re.compile(r"^\W*(?:args|arguments|params?|parameters|returns?|yields?|raises|throws|attributes|examples?|notes?|summary|see also|keyword arguments|rtype|description)\W*$", re.IGNORECASE)
_UNDERLINE = re.compile(r"^[\W_]*$")
_TAG = re.compile(r"(?:[@\\:]+(param|parameter|arg|argument|type|tparam|keyword|key|var|property|prop|throws|throw|raises|raise|exception)\b\s*(?:\{[^}]*\}\s*)?[\w$.*\[\]]*\s*:?)|(?:[@\\:]+(?:returns?|rtype|yields?|yield)\b\s*(?:\{[^}]*\})?\s*:?)", re.IGNORECASE)
_SPLIT = re.compile(r"[A-Z]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+|[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-case words; names are split at case changes and underscores."""
    return [w.lower() for w in _SPLIT.findall(text)]


def _stem(word: str) -> str:
    if word.endswith("isation") or word.endswith("ization"):
        return word[:-7]
    for end in ("ising", "izing", "ises", "izes", "ised", "ized", "ise", "ize"):
        if word.endswith(end) and len(word) > len(end) + 2:
            return word[: -len(end)]
    for end in ("ing", "ies", "ied", "es", "ed", "s", "e", "y"):
        if word.endswith(end) and len(word) > len(end) + 2:
            return word[: -len(end)]
    return word


def clean(doc: str) -> str:
    """The documentation without its comment signs."""
    lines = [_SIGNS.sub("", line) for line in _LINES.split(_QUOTES.sub("", doc.strip()))]
    return "\n".join(line.rstrip() for line in lines).strip()


def own_words(name: str | None, signature: str | None, more: str | None = None) -> frozenset[str]:
    words = {_stem(w) for t in (name, signature, more) if t for w in words_of(t)}
    if "init" in words or "constructor" in words:
        words |= {"init", "initial", "initialis", "construct", "instanc", "creat"}
    return frozenset(words)


def _is_order(text: str) -> bool | None:
    """Whether a line is a directive to a tool; None if it may be one."""
    text = text.lstrip("@ \t")
    found = _DIRECTIVE.match(text)
    if not found:
        return False
    rest = text[found.end() :]
    words = rest.split()
    sure = not words or text[: found.end()][-1] in ":-" or rest[0] in ":-=(/,[" or words[0].lower().strip(":-=") in _ORDERS or len(words) <= 3 and rest[-1] not in ".!?"
    return True if sure else None


def _line_kind(text: str, own: frozenset[str]) -> tuple[str, str]:
    """(tells, doubt or '', the line without tags)."""
    if not text or _UNDERLINE.match(text) or _NO_TEXT.match(text) or _SECTION.match(text) or _TO_DO.match(text):
        return "", text
    order = _is_order(text)
    if order:
        return "", text
    text = _TAG.sub(" ", text)
    words = words_of(text)
    rest = [w for w in words if w not in _EMPTY_WORDS and _stem(w) not in own]
    if not rest:
        return "", text
    whole = [w for w in words if _stem(w) not in own]
    if all(w in META_WORDS for w in whole) and any(w in _CORE_META for w in whole):
        return ("doubt" if len(words) > 2 else ""), text
    return ("doubt" if order is None or _MAY_BE_TO_DO.match(text) else "tells"), text


def _texts(doc: str, own: frozenset[str]) -> dict[str, str]:
    kept: dict[str, list[str]] = {"tells": [], "doubt": [], "": []}
    for line in clean(doc).split("\n"):
        kind, text = _line_kind(line.strip(), own)
        kept[kind].append(text)
    return {kind: "\n".join(lines) for kind, lines in kept.items()}


def telling_text(doc: str, own: frozenset[str]) -> str:
    """The lines that say more than the function's own words, tags, directives, headings and placeholders; '' if none does."""
    return _texts(doc, own)["tells"]


def doubtful_text(doc: str, own: frozenset[str]) -> str:
    """What may be a template: the lines in doubt where no line tells anything, or what is told about work on documentation."""
    texts = _texts(doc, own)
    return texts["doubt"] if not texts["tells"] else texts["tells"] if is_meta(texts["tells"]) else ""


def template_of(text: str, own: frozenset[str]) -> str:
    """The text's words, with the function's own masked but for those that speak about documentation."""
    return " ".join("_" if _stem(w) in own and w not in META_WORDS else w for w in words_of(text))


def is_meta(text: str) -> bool:
    """Whether the text speaks of documentation still to be written, so that a repeated template of it says nothing."""
    words = set(words_of(text))
    return bool(words & _CORE_META) and bool(words & _ABOUT_WORK)


#: Words about work on documentation that is still to be done.
_ABOUT_WORK = frozenset("todo write written later soon pending missing release yet nobody someone describe insert fill coming needed placeholder stub folgt fehlt später pendiente falta venir manquante".split())
#: What may be a template is one if functions of so many names have it.
REPEATED = 3


def judge(functions: DataFrame) -> DataFrame:
    """Adds ``description`` (cleaned), ``informative`` to functions (…, name, signature, context, doc).

    Other columns are kept, but for description, informative, says, template and repeated, which are replaced or left out.

    informative: whether the documentation says anything beyond the function's own name, signature and parameter
    names. Null documentation is not informative. What is in doubt (``doubtful_text``) is informative unless functions of
    at least REPEATED different names have the same template, counted by hashes over the whole corpus.
    """
    names = [c for c in functions.columns if c not in ("description", "informative", "says", "template", "repeated")]
    schema = functions.select(*names).schema
    at = {n: k for k, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            columns = [batch.column(at[c]).to_pylist() for c in ("name", "signature", "context", "doc")]
            texts, verdicts, hashes = [], [], []
            for name, signature, context, doc in zip(*columns):
                if doc is None:
                    texts.append(None)
                    verdicts.append(False)
                    hashes.append(None)
                    continue
                own = own_words(name, signature, context)
                texts.append(clean(doc))
                doubt = doubtful_text(doc, own)
                verdicts.append(bool(doubt or telling_text(doc, own)))
                hashes.append(xxhash.xxh3_64_intdigest(template_of(doubt, own)) - (1 << 63) if doubt else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string()), pa.array(verdicts, pa.bool_()), pa.array(hashes, pa.int64())], [*names, "description", "says", "template"]
            )

    from pyspark.sql import types as T

    out = T.StructType([*schema, T.StructField("description", T.StringType()), T.StructField("says", T.BooleanType()), T.StructField("template", T.LongType())])
    # The texts are judged once, for the counts and for the result.
    judged = durable(functions.select(*names).mapInArrow(run, out))
    named = judged.where("template IS NOT NULL").select("template", "name").distinct()
    repeated = named.groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= REPEATED).select("template", F.lit(True).alias("repeated"))
    return judged.join(repeated, "template", "left").select(*names, "description", (F.col("says") & F.col("repeated").isNull()).alias("informative"))


def attached_comments(positions: DataFrame, contents: DataFrame) -> DataFrame:
    """(path, line, doc) of functions at (path, line), where a comment is attached to them in contents (path, content).

    The distinct lines of a path are no more than its text has lines, so its group is bounded by the text. Lines outside the
    text, null lines and paths without content give no row.
    """
    asked = positions.where("line IS NOT NULL").groupBy("path").agg(F.collect_set("line").alias("lines"))
    joined = asked.join(contents.where("content IS NOT NULL").select("path", "content"), "path").select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("lang"), "content", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (path, line, doc)
                for path, lang, text, lines in zip(*(batch.column(i).to_pylist() for i in range(4)))
                for line, doc in attached(text, lang, lines)
                if doc is not None
            ]
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.string()), pa.array(list(columns[1]), pa.int32()), pa.array(list(columns[2]), pa.string())], ["path", "line", "doc"])

    return joined.mapInArrow(run, "path string, line int, doc string")
