"""Local grammar of Python: logical lines by shape, and the structure of their indentation.

Each logical line becomes a shape in which names, numbers and strings are alike; whether a shape is a statement or the
head of a block is decided once per worker. The lines' indentation and the order of clauses are then checked for
the whole text.
"""

from __future__ import annotations

import ast
import keyword
import warnings

from lodestrata.llm.lexing import tokenize

_KEYWORDS = frozenset(keyword.kwlist)
_SIGNS = frozenset("** // << >> <= >= == != -> := ... += -= *= /= %= &= |= ^= @= **= //= >>= <<=".split()) | frozenset("{}()[];,<>+-*/%&|^~:=.@")
_SOFT = frozenset(("match", "case", "type"))
#: What has to stand around a clause for it to be parsed alone.
_BEFORE = {"elif": "if x : pass\n", "else": "if x : pass\n", "except": "try : pass\n", "finally": "try : pass\n", "case": "match x :\n "}
_FOLLOWS = {"elif": ("if", "elif"), "except": ("try", "except"), "finally": ("try", "except", "try-else")}

_shapes: dict[str, bool] = {}


def parses(source: str) -> bool:
    """The exact check, by the running interpreter's own parser."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(source)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def _shape_is_valid(shape: str, first: str) -> bool:
    verdict = _shapes.get(shape)
    if verdict is None:
        if len(_shapes) > 200_000:
            _shapes.clear()
        body = shape + " pass" if shape.endswith(" :") else shape
        after = ""
        if first == "try":
            after = "\nfinally : pass"
        elif first == "@":
            after = "\ndef x ( ) : pass"
        elif first == "match" and shape.endswith(" :"):
            body, after = shape, "\n case _ : pass"
        verdict = parses(_BEFORE.get(first, "") + body + after)
        if not verdict and first == "else":
            verdict = parses("for x in x : pass\n" + body)
        _shapes[shape] = verdict
    return verdict


def logical_lines(tokens: list[str]) -> list[tuple[str, list[str]]] | None:
    """(indentation, words) of each logical line; None if a character begins no token or brackets do not fit."""
    lines: list[tuple[str, list[str]]] = []
    words: list[str] = []
    indent = ""
    depth = 0
    for token in tokens:
        if token in _SIGNS:
            if token in "([{":
                depth += 1
            elif token in ")]}":
                depth -= 1
            words.append(token)
            continue
        c = token[0]
        if c == "\n" or c == "\r":
            if depth <= 0:
                if words:
                    lines.append((indent, words))
                    words = []
                indent = token[max(token.rfind("\n"), token.rfind("\r")) + 1 :]
        elif token in _KEYWORDS:
            words.append(token)
        elif token[-1] == '"' or token[-1] == "'":
            if len(token) < 2:
                return None
            words.append("b''" if c in "bB" or token[1:2] in ("b", "B") else "''")
        elif c.isalpha() or c == "_" or c > "\x7f" and token.isidentifier():
            words.append(token if not words and token in _SOFT else "x")
        elif c.isdigit() or c == "." and len(token) > 1:
            words.append("1")
        else:
            return None
    if words:
        lines.append((indent, words))
    return lines


def fits(tokens: list[str]) -> bool:
    """Whether tokens of balanced text, the first being a line end, form a module."""
    lines = logical_lines(tokens)
    if lines is None:
        return False
    widths = [0]
    last = [""]  # the latest statement's kind at each open level
    expect, decorated = False, False
    parents = [""]
    opened = ""
    for indent, words in lines:
        width = len(indent.expandtabs(8))
        if expect:
            if width <= widths[-1]:
                return False
            widths.append(width)
            last.append("")
            parents.append(opened)
        elif width > widths[-1]:
            return False
        while width < widths[-1]:
            if last.pop() == "try" or decorated:
                return False
            widths.pop()
            parents.pop()
        if width != widths[-1]:
            return False
        first = words[0]
        is_head = words[-1] == ":"
        if first in _SOFT:
            used = first == "match" and is_head or first == "case" and parents[-1] == "match" or first == "type" and len(words) > 2 and words[1] == "x"
            if not used:
                first = words[0] = "x"
        if parents[-1] == "match" and first != "case":
            return False
        before = last[-1]
        if first == "else":
            kind = "try-else" if before == "except" else "else" if before in ("if", "elif", "for", "while", "async") else ""
            if not kind:
                return False
        elif first in _FOLLOWS:
            if before not in _FOLLOWS[first]:
                return False
            kind = first
        else:
            if before == "try":
                return False
            kind = first
        if decorated and first not in ("def", "class", "async", "@"):
            return False
        decorated = first == "@"
        if not _shape_is_valid(" ".join(words), first):
            return False
        last[-1] = kind
        expect, opened = is_head, first
    return not (expect or decorated or "try" in last)


def valid(text: str) -> bool:
    """Whether the text is a Python module: by shape, and where that says no, by the exact parser."""
    return fits(tokenize("\n" + text.removeprefix("﻿"), "py")) or parses(text)
