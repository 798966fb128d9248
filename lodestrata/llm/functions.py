"""Functions in source files, whole or broken, with the documentation that is attached to them.

A text becomes one string of token classes: comments, line ends, decorators, words, and bracket groups, which are folded as
they close. Wherever a block closes, the stretch before it is read by a generalised LL grammar with a graph-structured
stack: what stands before the function is water, then come its comment, its decorators and its head. Equal stretches are
parsed once per worker.

Errors are recovered from. A closing bracket of another kind ends the groups inside it as broken, and where brackets do not
fit, a declaration that begins no further right than an open block's line ends that block. A function is whole if its
groups are closed and hold neither a broken group nor the marks of a merge conflict; in a file that is not valid as a
whole, its text must also be valid by the language's own grammar.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import python_grammar, syntax
from lodestrata.llm.gll import Grammar, Parse
from lodestrata.llm.lexing import TOKENS

#: Classes: C comments of one line each, K block comment, D decorator, F word that begins functions, Q word that no head
#: has, W other words and signs, P A B closed groups, T block in a type, E =, R =>, n line end, _ blank line, ; and , themselves,
#: ! broken group or mark.
BLOCK_GRAMMAR: Grammar = {
    "unit": (("function",), ("water", "function")),
    "water": (("*",), ("*", "water")),
    "function": (("doc", "decorators", "head"), ("decorators", "head")),
    "doc": (("C",), ("K", "n")),
    "decorators": ((), ("decorator", "decorators")),
    "decorator": (("D", "end"), ("D", "P", "end")),
    "end": ((), ("n",)),
    "head": (("words", "F", "words", "P", "words", "B"), ("words", "F", "P", "words", "P", "words", "B"), ("words", "W", "P", "result", "B"), ("words", "E", "words", "P", "result", "R", "B"), ("words", "E", "words", "R", "B")),
    "result": ((), ("part", "result")),
    "words": ((), ("part", "words"), ("P", "words")),
    "part": (("W",), ("A",), ("T",), ("n",), (",",)),
}
_BEGINS = frozenset(("function", "func"))
_NO_HEAD = {
    "js": frozenset("if for while switch catch with else do try finally return throw new case class interface enum typeof await yield import".split()),
    "java": frozenset("if for while switch catch else do try finally return throw new case class interface enum assert import package".split()),
    "go": frozenset("if for switch else return go defer select range case default import package type".split()),
}
_NO_HEAD["ts"] = _NO_HEAD["js"]
#: Records have parameters, but their block is no function's.
_RECORD = re.compile(r"\brecord\s+\w+\s*[<(]")
_DECLARES = frozenset("function func class interface enum export public private protected static async abstract final type @".split())

_MARKS = r"(?:(?:<{7}|>{7}|\|{7})(?= |$)|={7}$)"
_SCAN = {
    lang: re.compile(
        r"(?P<C>//[^\n\r]*)|(?P<K>/\*[\s\S]*?\*/)|(?P<n>\r\n|[\n\r])|(?P<mark>^" + _MARKS + r"[^\n\r]*)|(?P<text>" + text + r")|(?P<D>@(?!interface\b)[\w.]+)|(?P<word>(?:[^\W\d]|\$)[\w$]*)"
        r"|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<R>=>)|(?P<E>=(?!=))|(?P<end>[;,])|(?P<W>[^\s])",
        re.MULTILINE,
    )
    for lang, text in {
        "js": r"\"(?:[^\"\\\n\r]|\\[\s\S])*\"|'(?:[^'\\\n\r]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`|(?:(?<=[(,=:\[!&|?{};\n])|(?<=[(,=:\[!&|?{};>] )|(?<=return ))/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n\r])*\]|[^/\\\n\r\[])+/[a-z]*",
        "java": r"\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n\r]|\\.)*\"|'(?:[^'\\\n\r]|\\.)*'",
        "go": r"\"(?:[^\"\\\n\r]|\\.)*\"|'(?:[^'\\\n\r]|\\.)*'|`[^`]*`",
    }.items()
}
_SCAN["ts"] = _SCAN["js"]
_GROUP = {"(": "P", "[": "A", "{": "B"}
_PARTNER = {")": "(", "]": "[", "}": "{"}
_LINES = re.compile(r"\r\n|\r|\n")
_BLANKS = re.compile(r"[^\S\n\r]*")


@dataclass(frozen=True)
class Function:
    """first: line of its first decorator or of its head; line, last: lines of its head and end; 1-based."""

    name: str
    first: int
    line: int
    last: int
    doc: str | None
    code: str


class _Open:
    """A group that is still open, or the whole text: its tokens' classes, and where each begins and ends."""

    def __init__(self, bracket: str, at: int, indent: int):
        self.bracket, self.at, self.indent, self.broken = bracket, at, indent, False
        self.classes: list[str] = []
        self.spans: list[tuple[int, int]] = []

    def add(self, kind: str, start: int, end: int) -> None:
        last = self.classes[-1] if self.classes else ""
        if kind == "n" and last in ("n", "_", "C", "c"):
            # A comment takes its line end along; a second line end leaves a blank line.
            self.classes[-1], self.spans[-1] = ("c", (self.spans[-1][0], end)) if last == "C" else ("_", (self.spans[-1][0], end))
            return
        if kind == "C" and last == "c":
            # Line comments on neighbouring lines are one.
            self.classes[-1], self.spans[-1] = "C", (self.spans[-1][0], end)
            return
        if kind == "W" and last == "W":
            self.spans[-1] = (self.spans[-1][0], end)
            return
        self.classes.append(kind)
        self.spans.append((start, end))


@lru_cache(maxsize=200_000)
def _parts(classes: str) -> tuple[int, int, int, int] | None:
    """(doc from, doc to, decorators from, head from) in the classes of a stretch that ends with a function; None if none does.

    Of several readings, the one with the longest comment, then the most decorators counts.
    """
    parse = Parse(BLOCK_GRAMMAR, classes, "unit")
    best: tuple[int, int, int, int] | None = None
    size = len(classes)
    for start, end in parse.spans("function"):
        if end != size:
            continue
        starts = [(e, True) for e in parse.ends[("doc", start)]] + [(start, False)]
        for after, has_doc in starts:
            for head in parse.ends[("decorators", after)]:
                # What a new or return stands before is an expression, unless the word for functions follows.
                if size in parse.ends[("head", head)] and ("F" in classes[head:] or classes[:head].rstrip("n")[-1:] != "Q"):
                    reading = (start if has_doc else after, after, after, head)
                    if best is None or (reading[1] - reading[0], head - after, head) > (best[1] - best[0], best[3] - best[2], best[3]):
                        best = reading
    return best


class _Reader:
    """Reads one text of a language with blocks."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang = text, lang
        self.starts = [0, *(m.end() for m in _LINES.finditer(text))]
        self.clean = True
        self.found: list[Function] = []

    def line_of(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def indent_of(self, at: int) -> int:
        start = self.starts[self.line_of(at) - 1]
        line = self.text[start:at]
        return len(line) - len(line.lstrip())

    def read(self, by_layout: bool) -> list[Function]:
        self.found = []
        self.clean = True
        stack = [_Open("", 0, -1)]
        top = stack[0]
        no_head = _NO_HEAD[self.lang]
        for match in _SCAN[self.lang].finditer(self.text):
            kind, start, end = match.lastgroup, match.start(), match.end()
            if kind == "word" or kind == "D":
                word = match.group()
                if by_layout and len(stack) > 1 and top.bracket == "{" and (kind == "D" or word in _DECLARES):
                    column = start - self.starts[self.line_of(start) - 1]
                    if not self.text[start - column : start].strip():
                        while len(stack) > 1 and stack[-1].indent >= column:
                            self._give_up(stack)
                        top = stack[-1]
                top.add("D" if kind == "D" else "F" if word in _BEGINS else "Q" if word in no_head else "W", start, end)
            elif kind == "open":
                sign = match.group()
                top = _Open(sign, start, self.indent_of(start) if by_layout and sign == "{" else -1)
                stack.append(top)
            elif kind == "close":
                partner = _PARTNER[match.group()]
                if not any(o.bracket == partner for o in stack):
                    self._spoil(stack, start, end)
                    continue
                while stack[-1].bracket != partner:
                    self._give_up(stack)
                closed = stack.pop()
                top = stack[-1]
                self._close(top, closed, end)
            elif kind == "mark":
                self._spoil(stack, start, end)
            elif kind == "end":
                top.add(match.group(), start, end)
            else:
                top.add("W" if kind == "text" else kind, start, end)
        if len(stack) > 1:
            self.clean = False
        return self.found

    def _spoil(self, stack: list[_Open], start: int, end: int) -> None:
        self.clean = False
        for o in stack:
            o.broken = True
        stack[0].broken = False
        stack[-1].add("!", start, end)

    def _give_up(self, stack: list[_Open]) -> None:
        """End the innermost group as broken; the groups around it are broken too, but for the text."""
        lost = stack.pop()
        self.clean = False
        for o in stack[1:]:
            o.broken = True
        around = stack[-1]
        around.add("!", lost.at, lost.at + 1)
        # Comments and decorators at its end belong to what comes next.
        k = len(lost.classes)
        while k and lost.classes[k - 1] in "CcKDn_":
            k -= 1
        around.classes += lost.classes[k:]
        around.spans += lost.spans[k:]

    def _close(self, around: _Open, group: _Open, end: int) -> None:
        kind = _GROUP[group.bracket]
        if kind == "B":
            before = self.text[max(0, group.at - 12) : group.at].rstrip()
            if self.lang == "ts" and before.endswith(":") or self.lang == "go" and not group.classes and before.endswith(("interface", "struct")):
                kind = "T"
        around.add(kind, group.at, end)
        if kind == "B" and not group.broken:
            self._function(around, end)

    def _function(self, around: _Open, end: int) -> None:
        """The function that ends with the block that has just closed, if the stretch before it reads as one."""
        classes = around.classes
        k = len(classes) - 1
        while k > 0 and classes[k - 1] not in ";B!":
            k -= 1
        # A comment on the line of what stands before belongs to that.
        while k < len(classes) - 1 and classes[k] in "Cc" and (k > 0 or around.bracket) and "\n" not in (gap := self.text[(around.spans[k - 1][1] if k else around.at) : around.spans[k][0]]) and "\r" not in gap:
            k += 1
        stretch = "".join(classes[k:]).replace("c", "C")
        parts = _parts(stretch)
        if parts is None:
            return
        doc_from, doc_to, decorators, head = parts
        spans = around.spans
        doc = None
        if doc_to > doc_from:
            doc = self.text[spans[k + doc_from][0] : spans[k + doc_from][1]].strip()
        word = _word_of(stretch, head)
        # A run of words may begin on the line of something else, so the head begins where its last line does.
        begin, stop = spans[k + word]
        line = self.line_of(begin + len(self.text[begin:stop].rstrip()) - 1)
        at = _BLANKS.match(self.text, self.starts[line - 1]).end()
        if around.at and around.bracket and at <= around.at:
            at = spans[k + word][0]
        first = spans[k + decorators][0] if decorators < head and stretch[decorators] == "D" else at
        name = _name(self.text[at:end])
        if name and not (self.lang == "java" and _RECORD.search(self.text[at : spans[k + len(stretch) - 1][0]])):
            self.found.append(Function(name, self.line_of(first), line, self.line_of(end - 1), doc, self.text[first:end]))


def _word_of(stretch: str, head: int) -> int:
    """Index of the token that holds the function's keyword or name, in the head that begins at ``head``."""
    if "F" in stretch[head:]:
        return stretch.index("F", head)
    sign = stretch.index("E", head) if "R" in stretch[head:] and "E" in stretch[head:] else stretch.index("P", head)
    at = sign - 1
    while at > head and stretch[at] in "nT":
        at -= 1
    return at


_NAMES = (
    re.compile(r"\bfunc(?:tion)?\b\s*\*?\s*(?:\([^)]*\)\s*)?([\w$]+)"),
    re.compile(r"([\w$]+)\s*(?::[^=]{1,200})?=\s*(?:async\s*)?(?:function\b|\(|[\w$]+\s*=>)"),
    re.compile(r"([\w$]+)\s*(?:<[^()]{0,200}>)?\s*\("),
)


def _name(code: str) -> str:
    head = code[: code.find("{")] if "{" in code else code
    for pattern in _NAMES:
        found = pattern.search(head)
        if found:
            return found.group(1)
    return ""


def _block_functions(text: str, lang: str) -> list[Function]:
    reader = _Reader(text, lang)
    found = reader.read(False)
    if reader.clean:
        return found
    return reader.read(True)


_HEAD = re.compile(r"(?:async\s+)?def\s+(\w+)")


def _python_functions(text: str) -> list[Function]:
    """By the tokens' logical lines: a function reaches to the last line that is indented further than its head."""
    from lodestrata.llm.docpairs import string_in_body

    starts = [0, *(m.end() for m in _LINES.finditer(text))]
    line_of = lambda at: bisect_right(starts, at)
    open_: list[tuple[int, int, int, str]] = []  # (indentation, first, head, name)
    found: list[Function] = []
    depth, line_start, last_end, decorated = 0, True, 0, -1

    def close(width: int) -> None:
        while open_ and open_[-1][0] >= width:
            _, first, head, name = open_.pop()
            begin = starts[line_of(first) - 1]
            margin, rows = text[begin:first], _LINES.split(text[first:last_end])
            code = "\n".join([rows[0], *(r.removeprefix(margin) for r in rows[1:])])
            found.append(Function(name, line_of(first), line_of(head), line_of(max(head, last_end - 1)), string_in_body(text, head), code))

    for match in TOKENS["py"].finditer(text):
        token = match.group(1)
        if not token:
            break
        at = match.start(1)
        if token[0] in "\n\r":
            line_start = depth <= 0
            continue
        head = None
        if token in ("def", "async", "class", "@") or line_start:
            begin = starts[line_of(at) - 1]
            if not text[begin:at].strip(" \t\f"):
                head = _HEAD.match(text, at)
                if depth > 0 and (head or token == "class"):
                    # A declaration at a line's start ends the brackets that a broken line has left open.
                    depth, line_start = 0, True
                if line_start:
                    width = len(text[begin:at].expandtabs(8))
                    close(width)
                    if token == "@":
                        decorated = at if decorated < 0 else decorated
                    elif head and token != "class":
                        open_.append((width, decorated if decorated >= 0 else at, at, head.group(1)))
                        decorated = -1
                    else:
                        decorated = -1
        line_start = False
        if token in ("(", "[", "{"):
            depth += 1
        elif token in (")", "]", "}"):
            depth = max(0, depth - 1)
        last_end = match.end(1)
    close(0)
    return found


_AROUND = {"js": ("class X {\n", "\n}"), "ts": ("class X {\n", "\n}"), "java": ("class X {\n", "\n}"), "go": ("package x\n", "\n")}


def _is_whole(function: Function, lang: str) -> bool:
    """Whether the function's own text is valid, alone or as a member of a class."""
    if lang == "py":
        return python_grammar.valid(function.code + "\n")
    before, after = _AROUND[lang]
    return syntax.is_valid(function.code, lang) or syntax.is_valid(before + function.code + after, lang)


def functions_of(text: str, lang: str, check: bool = True) -> tuple[list[Function], bool]:
    """(the functions of a text in the order in which they end, whether the text is valid); none for other languages.

    In a text that is not valid, functions that are not valid either are left out. Without ``check``, texts and functions count
    as valid, and only what brackets and indentation tell is left out.
    """
    text = text.removeprefix("﻿")
    if lang == "py":
        found = _python_functions(text)
    elif lang in _SCAN:
        found = _block_functions(text, lang)
    else:
        return [], True
    if not (check and found) or syntax.is_valid(text, lang):
        return found, True
    return [f for f in found if _is_whole(f, lang)], False


_ROW = "path string, name string, first int, line int, last int, doc string, code string, in_broken_file boolean"


def extract(contents: DataFrame) -> DataFrame:
    """One row per whole function of contents (path, content); the extension names the language.

    (path, name, first, line, last, doc, code, in_broken_file): lines are 1-based, doc is the attached comment or string with its
    signs, or null. Null contents and other languages give no row.
    """
    named = contents.where("content IS NOT NULL").select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("lang"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        string, number = pa.string(), pa.int32()
        kinds = [string, string, number, number, number, string, string, pa.bool_()]
        names = [part.split()[0] for part in _ROW.split(", ")]
        for batch in batches:
            rows = []
            for path, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found, valid = functions_of(text, lang)
                rows.extend((path, f.name, f.first, f.line, f.last, f.doc, f.code, not valid) for f in found)
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return named.mapInArrow(run, _ROW)
