"""Local grammars of JavaScript, TypeScript, Java and Go over token classes.

A text's tokens become one character each. Bracket groups are replaced from the inside out by one character that
stands for the group's class string, so that each statement is a short string without brackets. Whether a group
can be read in a role (block, arguments, parameters, object, type, ...) is decided when an outer statement asks for it,
and remembered per class string, as is the verdict on each statement. Equal shapes are thus parsed once per worker.
"""

from __future__ import annotations

import re
import sys


NUMBER, STRING, TEMPLATE, REGEX, PRIVATE, WORD, BAD, NL = "n", "s", "t", "r", "#", "i", "\x00", "\n"
_GROUP = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")
_FIRST_GROUP = 0x20000
_LAST_GROUP = 0x10EFFF
#: Symbols of classes of groups, for texts with more different shapes than there are symbols.
_FIRST_CLASS = 0x10F000
#: Shapes that a worker remembers before its tables start anew.
_MOST_GROUPS = 250_000
_MOST_LINES = 500_000


#: Passes over a text that each replace its innermost groups; deeper texts are reduced with a stack.
_PASSES = 60
#: Groups are read inside one another, so deep texts need a deep stack.
_DEPTH = 30_000


def reduce_nested(flat: str, symbol) -> str:  # noqa: ANN001
    """Replace bracket groups from the inside out in one pass, however deep they lie; brackets without a partner stay."""
    stack: list[list[str]] = [[]]
    for c in flat:
        if c in "([{":
            stack.append([c])
        elif c in ")]}" and len(stack) > 1 and stack[-1][0] + c in ("()", "[]", "{}"):
            text = "".join(stack.pop()) + c
            stack[-1].append(symbol(text))
        else:
            stack[-1].append(c)
    return "".join(c for part in stack for c in part)


class Wrong(Exception):
    """The text does not fit the grammar at this place."""


class Language:
    """Token classes, group table and verdicts of one language; subclassed parsers give the grammar."""

    name = ""
    lexer = ""
    keywords: tuple[str, ...] = ()
    soft: tuple[str, ...] = ()
    operators: tuple[str, ...] = ()
    line_ends_matter = True

    def __init__(self) -> None:
        words = [*self.keywords, *self.soft]
        self.code = {w: chr(0x100 + k) for k, w in enumerate(words)} | {o: chr(0x300 + k) for k, o in enumerate(self.operators)}
        self.code |= {c: c for c in "{}()[];,<>+-*/%&|^!~?:=.@"}
        self.soft_codes = frozenset(self.code[w] for w in self.soft)
        self.word_codes = frozenset(self.code[w] for w in words)
        sys.setrecursionlimit(max(sys.getrecursionlimit(), _DEPTH))
        self.reset()

    def reset(self) -> None:
        self.groups: dict[str, str] = {}
        self.bodies: list[str] = []
        self.classed: dict[tuple, str] = {}
        self.class_bodies: list[str] = []
        self.roles: dict[tuple[str, str], bool] = {}
        self.lines: dict[tuple[str, str], bool] = {}

    def classify(self, token: str) -> str:
        first = token[0]
        if first.isalpha() or first in "_$":
            return WORD
        if first in "\n\r":
            return NL
        if first.isdigit() or first == "." and len(token) > 1 and token[1].isdigit():
            return NUMBER
        if first == '"' or first == "'":
            return STRING if len(token) > 1 else BAD
        if first == "`":
            return (TEMPLATE if self.lexer == "js" else STRING) if len(token) > 1 and token.endswith("`") else BAD
        if first == "/" and len(token) > 1:
            if token[1] == "*":
                return (NL if "\n" in token or "\r" in token else "") if token.endswith("*/") and len(token) > 3 else BAD
            return REGEX
        if first == "#" and len(token) > 1:
            return PRIVATE
        return BAD

    def classes(self, tokens: list[str]) -> str:
        known = self.code.get
        return "".join([known(t) or self.classify(t) for t in tokens])

    def _group(self, match: re.Match) -> str:
        return self._symbol(match.group())

    def _symbol(self, text: str) -> str:
        symbol = self.groups.get(text)
        if symbol is None:
            if len(self.bodies) > _LAST_GROUP - _FIRST_GROUP:
                return self._class_symbol(text)
            symbol = self.groups[text] = chr(_FIRST_GROUP + len(self.bodies))
            self.bodies.append(text)
        return symbol

    def _class_symbol(self, text: str) -> str:
        """The symbol of all groups that are read in the same roles, which is all that outer statements ask of a group."""
        roles = (name.removeprefix("role_") for name in dir(self.reader("")) if name.startswith("role_"))
        key = (text[:2], *(self.whole(text[1:-1], role) for role in roles))
        symbol = self.classed.get(key)
        if symbol is None:
            symbol = self.classed[key] = chr(_FIRST_CLASS + len(self.class_bodies))
            self.class_bodies.append(text)
        return symbol

    def valid_tokens(self, tokens: list[str]) -> bool:
        """Whether the tokens of a balanced text form a unit of the language.

        What a worker remembers is bounded: between texts the tables start anew when they have grown large. In a text
        with more different group shapes than there are symbols (over 900,000), further ones share symbols by their roles.
        """
        if len(self.bodies) > _MOST_GROUPS or len(self.lines) > _MOST_LINES or len(self.roles) > _MOST_LINES:
            self.reset()
        flat = self.classes(tokens)
        if BAD in flat:
            return False
        flat = self.prepare(flat)
        for _ in range(_PASSES):
            smaller = _GROUP.sub(self._group, flat)
            if smaller == flat:
                break
            flat = smaller
        else:
            flat = reduce_nested(flat, self._deep_symbol)
        if BAD in flat or any(c in flat for c in "()[]{}"):
            return False
        try:
            return self.unit(flat)
        except (Wrong, IndexError, RecursionError):
            return False

    def _deep_symbol(self, text: str) -> str:
        """The group's symbol, with all its roles decided, so that groups around it need not descend into it."""
        symbol = self._symbol(text)
        for name in dir(self.reader("")):
            if name.startswith("role_"):
                self.fits(symbol, name.removeprefix("role_"))
        return symbol

    def prepare(self, flat: str) -> str:
        return flat

    def body(self, symbol: str) -> str:
        place = ord(symbol)
        return self.class_bodies[place - _FIRST_CLASS] if place >= _FIRST_CLASS else self.bodies[place - _FIRST_GROUP]

    def kind(self, symbol: str) -> str:
        """The opening bracket of a group symbol, '' for anything else."""
        return self.body(symbol)[0] if ord(symbol) >= _FIRST_GROUP else ""

    def fits(self, symbol: str, role: str) -> bool:
        key = (symbol, role)
        verdict = self.roles.get(key)
        if verdict is None:
            self.roles[key] = False
            verdict = self.roles[key] = self.whole(self.body(symbol)[1:-1], role)
        return verdict

    def whole(self, flat: str, role: str) -> bool:
        """Whether the whole string can be read in the role."""
        try:
            reader = self.reader(flat)
            getattr(reader, "role_" + role)()
            return reader.at == reader.n
        except (Wrong, IndexError):
            return False

    def reader(self, flat: str) -> Reader:
        raise NotImplementedError

    def unit(self, flat: str) -> bool:
        raise NotImplementedError

    def statements(self, flat: str, role: str) -> bool:
        """A statement list: most lines hold whole statements and are decided one by one, the rest together."""
        lines = self.lines
        for line in flat.split(NL):
            if line:
                verdict = lines.get((role, line))
                if verdict is None:
                    verdict = lines[role, line] = self.whole(line, role)
                if not verdict:
                    return self.whole(flat, role)
        return True


class Reader:
    """Recursive descent over a class string. ``nl[k]`` tells whether a line end stands before token k."""

    def __init__(self, lang: Language, flat: str):
        self.lang = lang
        self.code = lang.code
        if NL in flat:
            self.t: list[str] = []
            self.nl: list[bool] = []
            fresh = False
            for c in flat:
                if c == NL:
                    fresh = True
                else:
                    self.t.append(c)
                    self.nl.append(fresh)
                    fresh = False
            self.nl.append(True)
        else:
            self.t = list(flat)
            self.nl = [False] * (len(flat) + 1)
        self.n = len(self.t)
        self.t += ["", "", ""]
        self.at = 0

    def now(self) -> str:
        return self.t[self.at]

    def on(self, *texts: str) -> bool:
        c = self.t[self.at]
        return bool(c) and any(self.code[x] == c for x in texts)

    def next_is(self, *texts: str) -> bool:
        c = self.t[self.at + 1]
        return bool(c) and any(self.code[x] == c for x in texts)

    def skip(self, text: str) -> bool:
        if self.t[self.at] and self.t[self.at] == self.code[text]:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.skip(text):
            raise Wrong

    def is_name(self, offset: int = 0) -> bool:
        c = self.t[self.at + offset]
        return c == WORD or c in self.lang.soft_codes

    def name(self) -> None:
        if not self.is_name():
            raise Wrong
        self.at += 1

    def any_word(self) -> None:
        c = self.t[self.at]
        if c != WORD and c not in self.lang.word_codes:
            raise Wrong
        self.at += 1

    def group(self, bracket: str, role: str) -> None:
        if not self.has_group(bracket, role):
            raise Wrong
        self.at += 1

    def is_group(self, bracket: str, offset: int = 0) -> bool:
        c = self.t[self.at + offset]
        return bool(c) and self.lang.kind(c) == bracket

    def has_group(self, bracket: str, role: str) -> bool:
        return self.is_group(bracket) and self.lang.fits(self.t[self.at], role)

    def skip_group(self, bracket: str, role: str) -> bool:
        if self.has_group(bracket, role):
            self.at += 1
            return True
        return False

    def attempt(self, *steps) -> bool:
        """Run the steps; on failure go back to where they began."""
        start = self.at
        try:
            for step in steps:
                step()
            return True
        except (Wrong, IndexError):
            self.at = start
            return False

    def done(self) -> bool:
        return self.at >= self.n

    def comma_list(self, item, allow_empty: bool = True, trailing: bool = True) -> None:
        if self.done():
            if allow_empty:
                return
            raise Wrong
        while True:
            item()
            if not self.skip(","):
                return
            if self.done():
                if trailing:
                    return
                raise Wrong


# ---------------------------------------------------------------------------------------------------------------
# JavaScript and TypeScript

_JS_ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??=")
_JS_BINARY = ("+", "-", "*", "/", "%", "**", "<<", "<", ">", "<=", ">=", "==", "!=", "===", "!==", "&", "|", "^", "&&", "||", "??", "instanceof", "in")


class JavaScript(Language):
    name = "js"
    lexer = "js"
    keywords = (
        "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "enum", "export", "extends", "false", "finally", "for",
        "function", "if", "import", "in", "instanceof", "new", "null", "return", "super", "switch", "this", "throw", "true", "try", "typeof", "var", "void", "while", "with",
    )
    soft = (
        "abstract", "accessor", "as", "assert", "asserts", "async", "await", "constructor", "declare", "from", "get", "implements", "infer", "interface", "is", "keyof", "let",
        "module", "namespace", "of", "out", "override", "package", "private", "protected", "public", "readonly", "satisfies", "set", "static", "type", "unique", "yield", "global",
    )
    operators = tuple(o for o in dict.fromkeys([*_JS_ASSIGN, *_JS_BINARY, "...", "=>", "?.", "++", "--"]) if len(o) > 1 and not o.isalpha())
    typed = False

    def reader(self, flat: str) -> JsReader:
        return JsReader(self, flat)

    def unit(self, flat: str) -> bool:
        return self.statements(flat, "module")


class TypeScript(JavaScript):
    name = "ts"
    typed = True


class JsReader(Reader):
    lang: JavaScript

    def __init__(self, lang: JavaScript, flat: str):
        super().__init__(lang, flat)
        self.typed = lang.typed
        self.target = False
        code = lang.code
        self.assign_ops = frozenset(code[o] for o in _JS_ASSIGN)
        self.binary_ops = frozenset(code[o] for o in _JS_BINARY)

    # roles of whole strings and groups
    def role_module(self) -> None:
        while not self.done():
            if self.on("import") and not self.is_group("(", 1) and not self.next_is("."):
                self.import_declaration()
            elif self.on("export"):
                self.export_declaration()
            elif self.on("return", "break", "continue"):
                raise Wrong
            else:
                self.statement()

    def role_block_body(self) -> None:
        while not self.done():
            self.statement()

    def role_block(self) -> None:
        if not self.lang.statements("".join(c if not self.nl[k] else NL + c for k, c in enumerate(self.t[: self.n])), "block_body"):
            raise Wrong
        self.at = self.n

    def role_namespace(self) -> None:
        if not self.lang.statements("".join(c if not self.nl[k] else NL + c for k, c in enumerate(self.t[: self.n])), "module"):
            raise Wrong
        self.at = self.n

    def role_args(self) -> None:
        self.comma_list(self.argument)

    def role_expression(self) -> None:
        self.expression()

    def role_for(self) -> None:
        declared = self.on("var", "const") or self.on("let") and (self.is_name(1) or self.is_group("[", 1) or self.is_group("{", 1))
        if declared:
            self.at += 1
            self.bindings(False)
        elif not self.on(";"):
            self.expression(False)
        if self.skip("of"):
            self.assignment()
        elif self.skip("in"):
            self.expression()
        else:
            self.need(";")
            if not self.on(";"):
                self.expression()
            self.need(";")
            if not self.done():
                self.expression()

    def role_params(self) -> None:
        self.comma_list(self.parameter)

    def role_catch(self) -> None:
        self.binding_target()
        if self.typed and self.skip(":"):
            self.type()

    def role_index(self) -> None:
        self.expression()

    def role_array(self) -> None:
        while not self.done():
            if self.skip(","):
                continue
            self.argument()
            if not self.done():
                self.need(",")

    def role_array_pattern(self) -> None:
        while not self.done():
            if self.skip(","):
                continue
            rest = self.skip("...")
            self.pattern_element()
            if rest and not self.done():
                raise Wrong
            if not self.done():
                self.need(",")

    def role_object(self) -> None:
        self.comma_list(self.object_entry)

    def role_object_pattern(self) -> None:
        self.comma_list(self.pattern_entry)

    def role_class(self) -> None:
        while not self.done():
            if not self.skip(";"):
                self.class_member()

    def role_switch(self) -> None:
        while not self.done():
            if self.skip("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while not self.done() and not self.on("case", "default"):
                self.statement()

    def role_specifiers(self) -> None:
        def item() -> None:
            if self.typed and self.on("type") and not self.next_is(",", "as") and self.t[self.at + 1]:
                self.at += 1
            if not self.take(STRING):
                self.any_word()
            if self.skip("as") and not self.take(STRING):
                self.any_word()

        self.comma_list(item)

    def role_enum(self) -> None:
        def item() -> None:
            if not self.take(STRING):
                self.any_word()
            if self.skip("="):
                self.assignment()

        self.comma_list(item)

    def role_type(self) -> None:
        self.type()

    def role_tuple(self) -> None:
        def item() -> None:
            self.skip("...")
            if self.is_name() and (self.next_is(":") or self.next_is("?") and self.t[self.at + 2] == ":"):
                self.at += 1
                self.skip("?")
                self.need(":")
            self.type()
            self.skip("?")

        self.comma_list(item)

    def role_empty(self) -> None:
        pass

    def role_members(self) -> None:
        while not self.done():
            if self.skip(";") or self.skip(","):
                continue
            self.type_member()
            if not (self.done() or self.on(";", ",") or self.nl[self.at]):
                raise Wrong

    def role_index_signature(self) -> None:
        self.name()
        if self.skip("in"):
            self.type()
            if self.skip("as"):
                self.type()
        else:
            self.need(":")
            self.type()

    # statements
    def take(self, kind: str) -> bool:
        if self.t[self.at] == kind:
            self.at += 1
            return True
        return False

    def end_statement(self) -> None:
        if not (self.skip(";") or self.done() or self.nl[self.at]):
            raise Wrong

    def block(self) -> None:
        self.group("{", "block")

    def statement(self) -> None:
        c = self.now()
        if self.is_group("{"):
            self.block()
            return
        if c == ";":
            self.at += 1
            return
        if c == WORD:
            if self.next_is(":"):
                self.at += 2
                self.statement()
                return
        elif c in self.lang.word_codes or c == "@":
            if self.keyword_statement():
                return
        self.expression()
        self.end_statement()

    def keyword_statement(self) -> bool:
        if self.on("var", "const") or self.on("let") and (self.is_name(1) or self.is_group("[", 1) or self.is_group("{", 1)):
            if self.typed and self.on("const") and self.next_is("enum"):
                self.at += 1
                return self.keyword_statement()
            self.at += 1
            self.bindings(True)
            self.end_statement()
        elif self.on("function") or self.on("async") and self.next_is("function") and not self.nl[self.at + 1]:
            self.function(True)
        elif self.on("class", "@") or self.typed and self.on("abstract") and self.next_is("class"):
            self.decorators()
            if self.typed:
                self.skip("abstract")
            self.need("class")
            self.class_rest(True)
        elif self.skip("if"):
            self.group("(", "expression")
            self.statement()
            if self.skip("else"):
                self.statement()
        elif self.skip("for"):
            self.skip("await")
            self.group("(", "for")
            self.statement()
        elif self.skip("while"):
            self.group("(", "expression")
            self.statement()
        elif self.skip("do"):
            self.statement()
            self.need("while")
            self.group("(", "expression")
            self.skip(";")
        elif self.skip("switch"):
            self.group("(", "expression")
            self.group("{", "switch")
        elif self.skip("try"):
            self.block()
            caught = self.skip("catch")
            if caught:
                if self.is_group("("):
                    self.group("(", "catch")
                self.block()
            if self.skip("finally"):
                self.block()
            elif not caught:
                raise Wrong
        elif self.skip("throw"):
            if self.nl[self.at]:
                raise Wrong
            self.expression()
            self.end_statement()
        elif self.skip("return"):
            if not (self.done() or self.on(";") or self.nl[self.at]):
                self.expression()
            self.end_statement()
        elif self.on("break", "continue"):
            self.at += 1
            if self.is_name() and not self.nl[self.at]:
                self.at += 1
            self.end_statement()
        elif self.skip("debugger"):
            self.end_statement()
        elif self.skip("with"):
            self.group("(", "expression")
            self.statement()
        elif self.typed and self.typed_declaration():
            pass
        elif self.is_name() and self.next_is(":"):
            self.at += 2
            self.statement()
        else:
            return False
        return True

    def typed_declaration(self) -> bool:
        if self.on("interface") and self.is_name(1):
            self.at += 2
            self.type_params()
            if self.skip("extends"):
                self.type()
                while self.skip(","):
                    self.type()
            self.group("{", "members")
        elif self.on("type") and self.is_name(1) and not self.nl[self.at + 1]:
            self.at += 2
            self.type_params()
            self.need("=")
            self.type()
            self.end_statement()
        elif self.on("enum"):
            self.at += 1
            self.name()
            self.group("{", "enum")
        elif self.on("namespace", "module") and (self.is_name(1) or self.t[self.at + 1] == STRING):
            self.at += 2
            while self.skip("."):
                self.name()
            self.group("{", "namespace")
        elif self.on("global") and self.is_group("{", 1):
            self.at += 1
            self.group("{", "namespace")
        elif self.on("declare") and self.t[self.at + 1] in self.lang.word_codes and not self.nl[self.at + 1]:
            self.at += 1
            self.statement()
        else:
            return False
        return True

    def import_declaration(self) -> None:
        self.need("import")
        if not self.take(STRING):
            if self.typed and self.on("type") and not self.next_is("from", ","):
                self.at += 1
            if self.is_name():
                self.at += 1
                if self.typed and self.skip("="):
                    self.expression()
                    self.end_statement()
                    return
                if not self.on("from"):
                    self.need(",")
                    self.import_names()
            else:
                self.import_names()
            self.need("from")
            if not self.take(STRING):
                raise Wrong
        if self.on("with", "assert") and not self.nl[self.at]:
            self.at += 1
            self.group("{", "object")
        self.end_statement()

    def import_names(self) -> None:
        if self.skip("*"):
            self.need("as")
            self.name()
        else:
            self.group("{", "specifiers")

    def export_declaration(self) -> None:
        self.need("export")
        if self.skip("default"):
            if self.on("function") or self.on("async") and self.next_is("function"):
                self.function(False)
            elif self.on("class", "@") or self.typed and self.on("abstract"):
                self.decorators()
                self.skip("abstract") if self.typed else None
                self.need("class")
                self.class_rest(False)
            elif self.typed and self.on("interface") and self.is_name(1):
                self.typed_declaration()
            else:
                self.assignment()
                self.end_statement()
        elif self.skip("*"):
            if self.skip("as"):
                self.any_word()
            self.need("from")
            if not self.take(STRING):
                raise Wrong
            self.end_statement()
        elif self.is_group("{") or self.typed and self.on("type") and self.is_group("{", 1):
            self.skip("type") if self.typed else None
            self.group("{", "specifiers")
            if self.skip("from") and not self.take(STRING):
                raise Wrong
            self.end_statement()
        elif self.typed and self.skip("="):
            self.expression()
            self.end_statement()
        elif self.on("var", "const", "let", "function", "async", "class", "@") or self.typed and self.on("abstract", "interface", "type", "enum", "namespace", "module", "declare"):
            if not self.keyword_statement():
                raise Wrong
        else:
            raise Wrong

    def bindings(self, initial: bool) -> None:
        while True:
            self.binding_target()
            if self.typed:
                self.skip("!")
                if self.skip(":"):
                    self.type()
            if self.skip("="):
                self.assignment(initial)
            if not self.skip(","):
                return

    def binding_target(self) -> None:
        if self.is_group("["):
            self.group("[", "array_pattern")
        elif self.is_group("{"):
            self.group("{", "object_pattern")
        else:
            self.name()

    def pattern_element(self) -> None:
        # Assignment patterns may hold members, declarations only names; members are allowed in both here.
        if self.is_group("[") and self.lang.fits(self.now(), "array_pattern") or self.is_group("{") and self.lang.fits(self.now(), "object_pattern"):
            self.at += 1
        else:
            self.unary()
        if self.skip("="):
            self.assignment()

    def pattern_entry(self) -> None:
        if self.skip("..."):
            self.binding_target()
            return
        if self.is_name() and not self.next_is(":"):
            self.at += 1
            if self.skip("="):
                self.assignment()
            return
        self.property_key()
        self.need(":")
        self.pattern_element()

    def parameter(self) -> None:
        self.decorators()
        if self.typed:
            while self.on("public", "private", "protected", "readonly", "override") and (self.is_name(1) or self.is_group("{", 1) or self.is_group("[", 1)):
                self.at += 1
            if self.on("this") and self.next_is(":"):
                self.at += 2
                self.type()
                return
        rest = self.skip("...")
        self.binding_target()
        if self.typed:
            self.skip("?")
            if self.skip(":"):
                self.type()
        if self.skip("="):
            self.assignment()
        if rest and not self.done():
            raise Wrong

    def decorators(self) -> None:
        while self.skip("@"):
            self.unary()

    def function(self, named: bool) -> None:
        self.skip("async")
        self.need("function")
        self.skip("*")
        if self.is_name():
            self.at += 1
        elif named:
            raise Wrong
        self.signature()
        if self.is_group("{"):
            self.block()
        elif self.typed:
            self.end_statement()
        else:
            raise Wrong

    def signature(self) -> None:
        self.type_params()
        self.group("(", "params")
        if self.typed and self.skip(":"):
            self.return_type()

    def return_type(self) -> None:
        if self.on("asserts") and (self.is_name(1) or self.t[self.at + 1] == self.code["this"]):
            self.at += 2
            if self.skip("is"):
                self.type()
        elif (self.is_name() or self.on("this")) and self.next_is("is") and not self.nl[self.at + 1]:
            self.at += 2
            self.type()
        else:
            self.type()

    def class_rest(self, named: bool) -> None:
        if self.is_name() and not self.on("implements"):
            self.at += 1
        elif named:
            raise Wrong
        self.type_params()
        if self.skip("extends"):
            self.unary()
            if self.typed and self.on("<"):
                self.type_args()
        if self.typed and self.skip("implements"):
            self.type()
            while self.skip(","):
                self.type()
        self.group("{", "class")

    def class_member(self) -> None:
        self.decorators()
        if self.on("static") and self.is_group("{", 1):
            self.at += 1
            self.block()
            return
        words = ("static", "async", "get", "set", "accessor") + (("public", "private", "protected", "readonly", "abstract", "declare", "override") if self.typed else ())
        while self.on(*words):
            follows = self.t[self.at + 1]
            if not follows or follows in ";=,:?!" or self.is_group("(", 1) or follows == self.code["<"] or self.nl[self.at + 1] and not self.on("static", *words[5:]):
                break
            self.at += 1
        self.skip("*")
        if self.typed and self.is_group("[") and self.lang.fits(self.now(), "index_signature"):
            self.at += 1
            self.need(":")
            self.type()
            self.end_statement()
            return
        self.property_key()
        if self.typed:
            if not self.skip("?"):
                self.skip("!")
        if self.is_group("(") or self.on("<"):
            self.signature()
            if self.is_group("{"):
                self.block()
            elif self.typed:
                self.end_statement()
            else:
                raise Wrong
            return
        if self.typed and self.skip(":"):
            self.type()
        if self.skip("="):
            self.assignment()
        self.end_statement()

    def property_key(self) -> None:
        c = self.now()
        if c in (STRING, NUMBER, PRIVATE):
            self.at += 1
        elif self.is_group("["):
            self.group("[", "index")
        else:
            self.any_word()

    def object_entry(self) -> None:
        if self.skip("..."):
            self.assignment()
            return
        plain = True
        while self.on("get", "set", "async") and self.t[self.at + 1] and not self.next_is(",", ":", "=") and not self.is_group("(", 1):
            self.at += 1
            plain = False
        if self.skip("*"):
            plain = False
        name = self.is_name()
        self.property_key()
        if self.is_group("(") or self.typed and self.on("<"):
            self.signature()
            self.block()
        elif not plain:
            raise Wrong
        elif self.skip(":"):
            self.assignment()
        elif not name:
            raise Wrong
        elif self.skip("="):
            self.assignment()

    # expressions
    def expression(self, allow_in: bool = True) -> None:
        self.assignment(allow_in)
        while self.skip(","):
            self.assignment(allow_in)
            self.target = False

    def argument(self) -> None:
        self.skip("...")
        self.assignment()

    def assignment(self, allow_in: bool = True) -> None:
        if self.arrow(allow_in):
            return
        if self.on("yield") and not self.next_is(")", "="):
            self.at += 1
            star = self.skip("*")
            if star or not (self.done() or self.nl[self.at] or self.on(";", ",", ":")):
                self.assignment(allow_in)
            return
        self.binary(allow_in)
        if self.now() in self.assign_ops:
            if not self.target:
                raise Wrong
            self.at += 1
            self.assignment(allow_in)
            self.target = False
        elif self.skip("?"):
            self.assignment()
            self.need(":")
            self.assignment(allow_in)
            self.target = False

    def arrow(self, allow_in: bool) -> bool:
        start = self.at
        if self.on("async") and not self.nl[self.at + 1] and (self.is_group("(", 1) or self.is_name(1)):
            self.at += 1
        if self.is_name() and self.next_is("=>"):
            self.at += 2
        elif self.is_group("(") and self.next_is("=>"):
            self.group("(", "params")
            self.at += 1
        elif self.typed and (self.is_group("(") and self.next_is(":") or self.on("<")) and self.attempt(self.signature, lambda: self.need("=>")):
            pass
        else:
            self.at = start
            return False
        if self.is_group("{"):
            self.block()
        else:
            self.assignment(allow_in)
        self.target = False
        return True

    def binary(self, allow_in: bool) -> None:
        self.unary()
        while True:
            c = self.now()
            if c in self.binary_ops:
                if c == self.code["in"] and not allow_in:
                    return
                self.at += 1
                # Shifts to the right are read as single signs.
                while c == ">" and self.now() == ">":
                    self.at += 1
                self.unary()
                self.target = False
            elif self.typed and self.on("as", "satisfies") and not self.nl[self.at]:
                self.at += 1
                if not self.skip("const"):
                    self.type()
            else:
                return

    def unary(self) -> None:
        if self.on("+", "-", "!", "~", "typeof", "void", "delete") or self.on("await") and self.t[self.at + 1] and not self.next_is(";", ",", "=", ".", "=>") and not self.nl[self.at + 1]:
            self.at += 1
            self.unary()
            self.target = False
        elif self.on("++", "--"):
            self.at += 1
            self.unary()
            if not self.target:
                raise Wrong
            self.target = False
        elif self.typed and self.on("<") and self.attempt(self.type_args, self.unary):
            self.target = False
        else:
            self.postfix()

    def postfix(self) -> None:
        self.primary()
        while True:
            c = self.now()
            if not c:
                return
            if c == ".":
                self.at += 1
                if not self.take(PRIVATE):
                    self.any_word()
                self.target = True
            elif self.skip("?."):
                if self.is_group("("):
                    self.group("(", "args")
                elif self.is_group("["):
                    self.group("[", "index")
                elif not self.take(PRIVATE):
                    self.any_word()
                self.target = False
            elif self.is_group("("):
                self.group("(", "args")
                self.target = False
            elif self.is_group("["):
                self.group("[", "index")
                self.target = True
            elif c == TEMPLATE:
                self.at += 1
                self.target = False
            elif self.typed and c == "!" and not self.nl[self.at]:
                self.at += 1
            elif self.typed and c == "<" and self.attempt(self.type_args, self.called):
                self.target = False
            else:
                break
        if self.on("++", "--") and not self.nl[self.at]:
            if not self.target:
                raise Wrong
            self.at += 1
            self.target = False

    def called(self) -> None:
        if self.now() == TEMPLATE:
            self.at += 1
        else:
            self.group("(", "args")

    def primary(self) -> None:
        c = self.now()
        self.target = False
        if not c:
            raise Wrong
        if self.on("async") and self.next_is("function") and not self.nl[self.at + 1]:
            self.function(False)
        elif c == WORD or c in self.lang.soft_codes:
            self.at += 1
            self.target = True
        elif c in (NUMBER, STRING, TEMPLATE, REGEX):
            self.at += 1
        elif self.is_group("("):
            self.group("(", "expression")
            self.target = True
        elif self.is_group("["):
            self.target = self.lang.fits(c, "array_pattern")
            if not self.target or not self.is_assign(1):
                self.group("[", "array")
            else:
                self.at += 1
        elif self.is_group("{"):
            self.target = self.lang.fits(c, "object_pattern")
            if not self.target or not self.is_assign(1):
                self.group("{", "object")
            else:
                self.at += 1
        elif self.on("this", "null", "true", "false", "super"):
            self.at += 1
        elif self.on("function"):
            self.function(False)
            self.target = False
        elif self.on("class", "@"):
            self.decorators()
            self.need("class")
            self.class_rest(False)
        elif self.skip("new"):
            if self.skip("."):
                self.name()
                return
            self.new_target()
            if self.typed and self.on("<"):
                self.attempt(self.type_args)
            if self.is_group("("):
                self.group("(", "args")
            self.target = False
        elif self.skip("import"):
            if self.skip("."):
                self.name()
            else:
                self.group("(", "args")
        elif c == PRIVATE and self.next_is("in"):
            self.at += 1
        else:
            raise Wrong

    def is_assign(self, offset: int) -> bool:
        c = self.t[self.at + offset]
        return bool(c) and (c == "=" or c == self.code["of"] or c == self.code["in"])

    def new_target(self) -> None:
        self.primary()
        while True:
            if self.skip("."):
                if not self.take(PRIVATE):
                    self.any_word()
            elif self.is_group("["):
                self.group("[", "index")
            else:
                return

    # types
    def type_params(self) -> None:
        if not (self.typed and self.skip("<")):
            return
        while True:
            while self.on("const", "in", "out") and self.is_name(1):
                self.at += 1
            self.name()
            if self.skip("extends"):
                self.type()
            if self.skip("="):
                self.type()
            if self.skip(">"):
                return
            self.need(",")
            if self.skip(">"):
                return

    def type_args(self) -> None:
        self.need("<")
        while True:
            self.type()
            if self.skip(">"):
                return
            self.need(",")

    def type(self) -> None:
        if self.on("<") or self.on("new", "abstract") and (self.is_group("(", 1) or self.next_is("new", "<")):
            self.skip("abstract")
            self.skip("new")
            self.function_type()
            return
        if self.is_group("(") and self.next_is("=>"):
            self.function_type()
            return
        self.union()
        if self.on("extends") and not self.nl[self.at]:
            self.at += 1
            self.union()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def function_type(self) -> None:
        self.type_params()
        self.group("(", "params")
        self.need("=>")
        self.return_type()

    def union(self) -> None:
        self.skip("|")
        while True:
            self.skip("&")
            self.type_operand()
            while self.skip("&"):
                self.type_operand()
            if not self.skip("|"):
                return

    def type_operand(self) -> None:
        if self.on("keyof", "readonly", "unique", "infer") and self.t[self.at + 1] and not self.next_is(",", ";", "|", "&", "=", ">", ")", "["):
            self.at += 1
            self.type_operand()
            return
        c = self.now()
        if self.is_group("("):
            if self.next_is("=>"):
                self.function_type()
                return
            self.group("(", "type")
        elif self.is_group("{"):
            self.group("{", "members")
        elif self.is_group("["):
            self.group("[", "tuple")
        elif c in (STRING, NUMBER, TEMPLATE):
            self.at += 1
        elif c == "-" and self.t[self.at + 1] == NUMBER:
            self.at += 2
        elif self.on("void", "null", "true", "false", "this"):
            self.at += 1
        elif self.skip("typeof"):
            if self.skip("import"):
                self.group("(", "args")
            else:
                self.any_word()
            while self.skip("."):
                self.any_word()
        elif self.skip("import"):
            self.group("(", "args")
            while self.skip("."):
                self.any_word()
            if self.on("<"):
                self.type_args()
        else:
            self.name()
            while self.skip("."):
                self.any_word()
            if self.on("<") and not self.nl[self.at]:
                self.type_args()
        while self.is_group("[") and not self.nl[self.at]:
            if not (self.skip_group("[", "empty") or self.skip_group("[", "type")):
                raise Wrong

    def type_member(self) -> None:
        if self.is_group("(") or self.on("<"):
            self.signature()
            return
        if self.on("new") and (self.is_group("(", 1) or self.next_is("<")):
            self.at += 1
            self.signature()
            return
        if self.on("+", "-"):
            self.at += 1
        while self.on("readonly", "get", "set") and self.t[self.at + 1] and not self.next_is(":", "?", ",", ";") and not self.is_group("(", 1):
            self.at += 1
        if self.is_group("[") and self.lang.fits(self.now(), "index_signature"):
            self.at += 1
            if self.on("+", "-"):
                self.at += 1
            self.skip("?")
            self.need(":")
            self.type()
            return
        self.property_key()
        self.skip("?")
        if self.is_group("(") or self.on("<"):
            self.signature()
        elif self.skip(":"):
            self.type()


# ---------------------------------------------------------------------------------------------------------------
# Java

_C_ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=")
_JAVA_BINARY = ("+", "-", "*", "/", "%", "<<", "<", ">", "<=", ">=", "==", "!=", "&", "|", "^", "&&", "||")
_PRIMITIVES = ("boolean", "byte", "char", "double", "float", "int", "long", "short")
_MODIFIERS = ("public", "protected", "private", "static", "abstract", "final", "native", "synchronized", "transient", "volatile", "strictfp", "default")


class Java(Language):
    name = "java"
    lexer = "java"
    keywords = (
        "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue", "default", "do", "double", "else", "enum", "extends", "final",
        "finally", "float", "for", "goto", "if", "implements", "import", "instanceof", "int", "interface", "long", "native", "new", "package", "private", "protected", "public",
        "return", "short", "static", "strictfp", "super", "switch", "synchronized", "this", "throw", "throws", "transient", "try", "void", "volatile", "while", "true", "false", "null",
    )
    soft = ("record", "sealed", "permits", "var", "yield", "when", "non", "open", "module")
    operators = tuple(o for o in dict.fromkeys([*_C_ASSIGN, *_JAVA_BINARY, "...", "->", "::", "++", "--"]) if len(o) > 1)

    def reader(self, flat: str) -> JavaReader:
        return JavaReader(self, flat)

    def unit(self, flat: str) -> bool:
        return self.whole(flat, "unit")


class JavaReader(Reader):
    def __init__(self, lang: Language, flat: str):
        super().__init__(lang, flat)
        self.assign_ops = frozenset(lang.code[o] for o in _C_ASSIGN)
        self.binary_ops = frozenset(lang.code[o] for o in _JAVA_BINARY)
        self.effect = False

    def role_unit(self) -> None:
        if self.on("@"):
            self.attempt(self.modifiers, lambda: self.need("package")) and self.qualified_end()
        elif self.skip("package"):
            self.qualified_end()
        while not self.done():
            if self.skip(";"):
                continue
            if self.skip("import"):
                self.skip("static")
                self.qualified()
                if self.skip("."):
                    self.need("*")
                self.need(";")
            else:
                break
        while not self.done():
            if self.skip(";"):
                continue
            self.modifiers()
            if not self.type_declaration():
                raise Wrong

    def qualified(self) -> None:
        self.name()
        while self.on(".") and self.is_name(1):
            self.at += 2

    def qualified_end(self) -> None:
        self.qualified()
        self.need(";")

    def modifiers(self) -> None:
        while True:
            if self.on("@") and not self.next_is("interface"):
                self.at += 1
                self.qualified()
                if self.is_group("("):
                    self.group("(", "annotation")
            elif self.on("default") and (self.next_is(":", "->")):
                return
            elif self.on(*_MODIFIERS):
                self.at += 1
            elif self.on("sealed") and (self.is_name(1) or self.t[self.at + 1] in self.lang.word_codes):
                self.at += 1
            elif self.on("non") and self.next_is("-"):
                self.at += 2
                self.need("sealed")
            else:
                return

    def type_declaration(self) -> bool:
        if self.on("class", "interface"):
            self.at += 1
        elif self.on("enum"):
            self.at += 1
            self.name()
            if self.skip("implements"):
                self.types()
            self.group("{", "enum")
            return True
        elif self.on("@") and self.next_is("interface"):
            self.at += 2
            self.name()
            self.group("{", "class")
            return True
        elif self.on("record") and self.is_name(1) and (self.is_group("(", 2) or self.t[self.at + 2] == "<"):
            self.at += 2
            self.type_params()
            self.group("(", "params")
            if self.skip("implements"):
                self.types()
            self.group("{", "class")
            return True
        else:
            return False
        self.name()
        self.type_params()
        for word in ("extends", "implements", "permits"):
            if self.skip(word):
                self.types()
        self.group("{", "class")
        return True

    def types(self) -> None:
        self.type()
        while self.skip(","):
            self.type()

    def type_params(self) -> None:
        if self.skip("<"):
            while True:
                self.modifiers()
                self.name()
                if self.skip("extends"):
                    self.type()
                    while self.skip("&"):
                        self.type()
                if self.skip(">"):
                    return
                self.need(",")

    def type(self, dims: bool = True) -> None:
        self.modifiers() if self.on("@") else None
        if self.on(*_PRIMITIVES):
            self.at += 1
        else:
            while True:
                self.name()
                if self.on("<"):
                    self.type_args()
                if not (self.on(".") and self.is_name(1)):
                    break
                self.at += 1
        if dims:
            self.dims()

    def dims(self) -> None:
        while self.skip_group("[", "empty"):
            pass

    def type_args(self) -> None:
        self.need("<")
        if self.skip(">"):
            return
        while True:
            self.modifiers() if self.on("@") else None
            if self.skip("?"):
                if self.on("extends", "super"):
                    self.at += 1
                    self.type()
            else:
                self.type()
            if self.skip(">"):
                return
            self.need(",")

    def role_empty(self) -> None:
        pass

    def role_annotation(self) -> None:
        def item() -> None:
            if self.is_name() and self.next_is("="):
                self.at += 2
            self.value()

        self.comma_list(item, trailing=False)

    def value(self) -> None:
        if self.on("@"):
            self.modifiers()
        elif self.is_group("{"):
            self.group("{", "array")
        else:
            self.expression()

    def role_array(self) -> None:
        self.comma_list(self.value)

    def role_params(self) -> None:
        def item() -> None:
            self.modifiers()
            self.type()
            self.skip("...")
            if not self.skip("this"):
                self.name()
            self.dims()

        self.comma_list(item, trailing=False)

    def role_lambda(self) -> None:
        if not self.attempt(self.role_params) or not self.done():
            self.at = 0
            self.comma_list(self.name, trailing=False)

    def role_args(self) -> None:
        self.comma_list(self.expression, trailing=False)

    def role_expression(self) -> None:
        self.expression()

    def role_cast(self) -> None:
        self.type()
        while self.skip("&"):
            self.type()

    def role_catch(self) -> None:
        self.modifiers()
        self.type()
        while self.skip("|"):
            self.type()
        self.name()

    def role_resources(self) -> None:
        while True:
            if not self.attempt(self.modifiers, self.type, self.name, lambda: self.need("="), self.expression):
                self.expression()
            if not self.skip(";") or self.done():
                return

    def role_for(self) -> None:
        if self.attempt(self.modifiers, self.type, self.name, lambda: self.need(":")):
            self.expression()
            return
        if not self.on(";"):
            if not self.attempt(self.modifiers, self.type, self.declarators):
                self.expression()
                while self.skip(","):
                    self.expression()
        self.need(";")
        if not self.on(";"):
            self.expression()
        self.need(";")
        if not self.done():
            self.expression()
            while self.skip(","):
                self.expression()

    def role_enum(self) -> None:
        while self.is_name() or self.on("@"):
            self.modifiers()
            self.name()
            if self.is_group("("):
                self.group("(", "args")
            if self.is_group("{"):
                self.group("{", "class")
            if not self.skip(","):
                break
        if not self.done():
            self.need(";")
            self.role_class()

    def role_class(self) -> None:
        while not self.done():
            if self.skip(";"):
                continue
            self.member()

    def member(self) -> None:
        if self.on("static") and self.is_group("{", 1):
            self.at += 1
        if self.is_group("{"):
            self.block()
            return
        self.modifiers()
        if self.type_declaration():
            return
        self.type_params()
        if self.is_name() and (self.is_group("(", 1) or self.is_group("{", 1)):
            self.at += 1
            if self.is_group("("):
                self.group("(", "params")
                self.throws()
            self.block()
            return
        if not self.skip("void"):
            self.type()
        if self.is_name() and self.is_group("(", 1):
            self.at += 1
            self.group("(", "params")
            self.dims()
            self.throws()
            if self.skip("default"):
                self.value()
            if self.is_group("{"):
                self.block()
            else:
                self.need(";")
            return
        self.declarators()
        self.need(";")

    def throws(self) -> None:
        if self.skip("throws"):
            self.types()

    def declarators(self) -> None:
        while True:
            self.name()
            self.dims()
            if self.skip("="):
                self.value()
            if not self.skip(","):
                return

    def block(self) -> None:
        self.group("{", "block")

    def role_block(self) -> None:
        if not self.lang.statements("".join(c if not self.nl[k] else NL + c for k, c in enumerate(self.t[: self.n])), "block_body"):
            raise Wrong
        self.at = self.n

    def role_block_body(self) -> None:
        while not self.done():
            self.statement()

    def role_switch(self) -> None:
        while not self.done():
            if self.skip("case"):
                self.label()
                while self.skip(","):
                    self.label()
                if self.skip("when"):
                    self.expression()
            else:
                self.need("default")
            if self.skip("->"):
                if self.is_group("{") or self.on("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while not self.done() and not self.on("case") and not (self.on("default") and self.next_is(":", "->")):
                    self.statement()

    def label(self) -> None:
        if self.skip("default"):
            return
        if not self.attempt(self.modifiers, self.type, self.name):
            self.ternary()

    def statement(self) -> None:
        c = self.now()
        if self.is_group("{"):
            self.block()
        elif c == ";":
            self.at += 1
        elif self.is_name() and self.next_is(":"):
            self.at += 2
            self.statement()
        elif self.skip("if"):
            self.group("(", "expression")
            self.statement()
            if self.skip("else"):
                self.statement()
        elif self.skip("for"):
            self.group("(", "for")
            self.statement()
        elif self.skip("while"):
            self.group("(", "expression")
            self.statement()
        elif self.skip("do"):
            self.statement()
            self.need("while")
            self.group("(", "expression")
            self.need(";")
        elif self.skip("try"):
            resources = self.is_group("(")
            if resources:
                self.group("(", "resources")
            self.block()
            caught = False
            while self.skip("catch"):
                self.group("(", "catch")
                self.block()
                caught = True
            if self.skip("finally"):
                self.block()
            elif not (caught or resources):
                raise Wrong
        elif self.on("switch"):
            self.at += 1
            self.group("(", "expression")
            self.group("{", "switch")
            if self.on("."):
                raise Wrong
        elif self.on("return", "throw"):
            needs = self.on("throw")
            self.at += 1
            if needs or not self.on(";"):
                self.expression()
            self.need(";")
        elif self.on("yield") and not self.next_is("=", ".", "++", "--") and not self.is_group("(", 1):
            self.at += 1
            self.expression()
            self.need(";")
        elif self.on("break", "continue"):
            self.at += 1
            if self.is_name():
                self.at += 1
            self.need(";")
        elif self.on("synchronized") and self.is_group("(", 1):
            self.at += 1
            self.group("(", "expression")
            self.block()
        elif self.skip("assert"):
            self.expression()
            if self.skip(":"):
                self.expression()
            self.need(";")
        else:
            start = self.at
            self.modifiers()
            if self.type_declaration():
                return
            if self.at == start and not self.attempt(self.type, self.declarators, lambda: self.need(";")):
                self.expression()
                if not self.effect:
                    raise Wrong
                self.need(";")
            elif self.at > start and self.t[self.at - 1] != ";":
                self.type()
                self.declarators()
                self.need(";")

    def expression(self) -> None:
        if self.is_name() and self.next_is("->"):
            self.at += 2
            self.lambda_body()
            return
        if self.is_group("(") and self.next_is("->"):
            self.group("(", "lambda")
            self.at += 1
            self.lambda_body()
            return
        self.ternary()
        if self.now() in self.assign_ops:
            self.at += 1
            self.expression()
            self.effect = True

    def lambda_body(self) -> None:
        if self.is_group("{"):
            self.block()
        else:
            self.expression()
        self.effect = False

    def ternary(self) -> None:
        self.binary()
        if self.skip("?"):
            self.expression()
            self.need(":")
            self.expression()
            self.effect = False

    def binary(self) -> None:
        self.unary()
        while True:
            c = self.now()
            if c in self.binary_ops:
                self.at += 1
                while c == ">" and self.now() == ">":
                    self.at += 1
                self.unary()
                self.effect = False
            elif self.skip("instanceof"):
                self.modifiers()
                self.type()
                if self.is_name():
                    self.at += 1
                elif self.is_group("("):
                    self.at += 1
                self.effect = False
            else:
                return

    def unary(self) -> None:
        if self.on("++", "--"):
            self.at += 1
            self.unary()
            self.effect = True
        elif self.on("+", "-", "!", "~"):
            self.at += 1
            self.unary()
            self.effect = False
        elif self.is_group("(") and self.lang.fits(self.now(), "cast") and self.attempt(self.cast):
            self.effect = False
        else:
            self.postfix()

    def cast(self) -> None:
        body = self.lang.body(self.now())
        primitive = body[1:2] in [self.code[p] for p in _PRIMITIVES]
        self.at += 1
        if not primitive and self.on("+", "-", "++", "--"):
            raise Wrong
        if self.is_name() and self.next_is("->") or self.is_group("(") and self.next_is("->"):
            self.expression()
        else:
            self.unary()

    def postfix(self) -> None:
        self.primary()
        while True:
            if self.on(".") :
                self.at += 1
                if self.on("<"):
                    self.type_args()
                if self.skip("new"):
                    self.creation()
                    self.effect = True
                    continue
                if not (self.skip("class") or self.skip("this") or self.skip("super")):
                    self.name()
                if self.is_group("("):
                    self.group("(", "args")
                    self.effect = True
                else:
                    self.effect = False
            elif self.is_group("["):
                if self.skip_group("[", "empty"):
                    self.dims()
                    if not self.on("::", "."):
                        raise Wrong
                else:
                    self.group("[", "expression")
                self.effect = False
            elif self.skip("::"):
                if self.on("<"):
                    self.type_args()
                if not self.skip("new"):
                    self.name()
                self.effect = False
            elif self.on("++", "--"):
                self.at += 1
                self.effect = True
            else:
                return

    def primary(self) -> None:
        self.effect = False
        c = self.now()
        if c in (NUMBER, STRING) and c:
            self.at += 1
        elif self.on("true", "false", "null"):
            self.at += 1
        elif self.on("this", "super"):
            self.at += 1
            if self.is_group("("):
                self.group("(", "args")
                self.effect = True
        elif self.is_group("("):
            self.group("(", "expression")
        elif self.skip("new"):
            self.creation()
            self.effect = True
        elif self.skip("switch"):
            self.group("(", "expression")
            self.group("{", "switch")
        elif self.on(*_PRIMITIVES) or self.on("void"):
            self.at += 1
            self.dims()
            if self.skip("::"):
                self.need("new")
            else:
                self.need(".")
                self.need("class")
        elif self.is_name():
            if self.t[self.at + 1] == "<" and self.attempt(self.type, lambda: self.need("::")):
                if not self.skip("new"):
                    self.name()
                return
            self.at += 1
            if self.is_group("("):
                self.group("(", "args")
                self.effect = True
        else:
            raise Wrong

    def creation(self) -> None:
        self.type(dims=False)
        if self.is_group("("):
            self.group("(", "args")
            if self.is_group("{"):
                self.group("{", "class")
            return
        if not self.is_group("["):
            raise Wrong
        if self.skip_group("[", "empty"):
            self.dims()
            self.group("{", "array")
            return
        while self.skip_group("[", "expression"):
            pass
        self.dims()


# ---------------------------------------------------------------------------------------------------------------
# Go

_GO_ASSIGN = ("=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^=")
_GO_BINARY = ("+", "-", "*", "/", "%", "<<", ">>", "&^", "<", ">", "<=", ">=", "==", "!=", "&", "|", "^", "&&", "||")


class Go(Language):
    name = "go"
    lexer = "go"
    keywords = (
        "break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if", "import", "interface", "map", "package",
        "range", "return", "select", "struct", "switch", "type", "var",
    )
    operators = tuple(o for o in dict.fromkeys([*_GO_ASSIGN, *_GO_BINARY, "...", "<-", "++", "--"]) if len(o) > 1)

    def __init__(self) -> None:
        super().__init__()
        ends = "".join(self.code[w] for w in ("break", "continue", "fallthrough", "return", "++", "--"))
        self.line_end = re.compile(rf"([{WORD}{NUMBER}{STRING}){ends}\]}}])\n")

    def prepare(self, flat: str) -> str:
        """Line ends after a token that can end a statement become semicolons, the others vanish."""
        return self.line_end.sub(r"\1;", flat + NL).replace(NL, "")

    def reader(self, flat: str) -> GoReader:
        return GoReader(self, flat)

    def unit(self, flat: str) -> bool:
        return self.whole(flat, "unit")

    def statements(self, flat: str, role: str) -> bool:
        lines = self.lines
        for line in flat.split(";"):
            if line:
                verdict = lines.get((role, line))
                if verdict is None:
                    verdict = lines[role, line] = self.whole(line, role)
                if not verdict:
                    return self.whole(flat, role)
        return True


class GoReader(Reader):
    def __init__(self, lang: Language, flat: str):
        super().__init__(lang, flat)
        self.assign_ops = frozenset(lang.code[o] for o in _GO_ASSIGN)
        self.binary_ops = frozenset(lang.code[o] for o in _GO_BINARY)
        #: In the head of if, for and switch a brace begins the block, not a literal.
        self.head = False

    def end(self) -> None:
        if not (self.done() or self.skip(";")):
            raise Wrong

    def role_unit(self) -> None:
        self.need("package")
        self.name()
        self.end()
        while self.skip("import"):
            if self.is_group("("):
                self.group("(", "imports")
            else:
                self.import_spec()
            self.end()
        while not self.done():
            if self.on("func"):
                self.function(True)
            elif not self.declaration():
                raise Wrong
            self.end()

    def import_spec(self) -> None:
        if self.is_name() or self.on("."):
            self.at += 1
        if self.now() != STRING:
            raise Wrong
        self.at += 1

    def specs(self, spec) -> None:
        while not self.done():
            spec()
            self.end()

    def role_imports(self) -> None:
        self.specs(self.import_spec)

    def role_consts(self) -> None:
        self.specs(self.const_spec)

    def role_vars(self) -> None:
        self.specs(self.var_spec)

    def role_types(self) -> None:
        self.specs(self.type_spec)

    def names(self) -> None:
        self.name()
        while self.skip(","):
            self.name()

    def const_spec(self) -> None:
        self.names()
        if not (self.done() or self.on("=", ";")):
            self.type()
        if self.skip("="):
            self.expressions()

    def var_spec(self) -> None:
        self.names()
        if self.skip("="):
            self.expressions()
            return
        self.type()
        if self.skip("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.is_group("[") and not self.lang.fits(self.now(), "empty") and self.attempt(lambda: self.group("[", "type_params"), self.type):
            return
        self.skip("=")
        self.type()

    def role_type_params(self) -> None:
        def item() -> None:
            self.name()
            if not (self.done() or self.on(",")):
                self.constraint()

        self.comma_list(item, allow_empty=False)

    def constraint(self) -> None:
        while True:
            self.skip("~")
            self.type()
            if not self.skip("|"):
                return

    def declaration(self) -> bool:
        for word, spec, role in (("const", self.const_spec, "consts"), ("var", self.var_spec, "vars"), ("type", self.type_spec, "types")):
            if self.skip(word):
                if self.is_group("("):
                    self.group("(", role)
                else:
                    spec()
                return True
        return False

    def function(self, named: bool) -> None:
        self.need("func")
        if named:
            if self.is_group("("):
                self.group("(", "params")
            self.name()
            if self.is_group("["):
                self.group("[", "type_params")
        self.signature()
        if self.is_group("{"):
            self.block()
        elif not named:
            raise Wrong

    def signature(self) -> None:
        self.group("(", "params")
        if self.is_group("("):
            self.group("(", "params")
        elif not self.is_group("{") and self.starts_type():
            self.type()

    def starts_type(self) -> bool:
        return self.is_name() or self.on("*", "func", "map", "chan", "struct", "interface", "<-") or self.is_group("[") or self.is_group("(")

    def role_params(self) -> None:
        def item() -> None:
            if self.skip("..."):
                self.type()
                return
            if self.is_name() and self.t[self.at + 1] and not self.next_is(",", "."):
                start = self.at
                self.at += 1
                self.skip("...")
                if self.attempt(self.type) and (self.done() or self.on(",")):
                    return
                self.at = start
            self.type()

        self.comma_list(item)

    def type(self) -> None:
        if self.is_name():
            self.at += 1
            if self.on(".") and self.is_name(1):
                self.at += 2
            if self.is_group("[") and self.lang.fits(self.now(), "type_list"):
                self.at += 1
        elif self.skip("*"):
            self.type()
        elif self.is_group("("):
            self.group("(", "type")
        elif self.is_group("["):
            self.array_type()
        elif self.skip("map"):
            self.group("[", "type")
            self.type()
        elif self.skip("chan"):
            self.skip("<-")
            self.type()
        elif self.skip("<-"):
            self.need("chan")
            self.type()
        elif self.skip("func"):
            self.signature()
        elif self.skip("struct"):
            self.group("{", "struct")
        elif self.skip("interface"):
            self.group("{", "interface")
        else:
            raise Wrong

    def array_type(self) -> None:
        if not (self.skip_group("[", "empty") or self.skip_group("[", "length")):
            raise Wrong
        self.type()

    def role_type(self) -> None:
        self.type()

    def role_type_list(self) -> None:
        self.comma_list(self.type, allow_empty=False)

    def role_empty(self) -> None:
        pass

    def role_length(self) -> None:
        if not self.skip("..."):
            self.expression()

    def role_struct(self) -> None:
        while not self.done():
            if self.skip("*"):
                self.type()
            elif self.is_name() and (not self.t[self.at + 1] or self.next_is(";", ".") or self.t[self.at + 1] == STRING):
                self.type()
            else:
                self.names()
                self.type()
            if self.now() == STRING:
                self.at += 1
            self.end()

    def role_interface(self) -> None:
        while not self.done():
            if self.is_name() and self.is_group("(", 1):
                self.at += 1
                self.signature()
            else:
                self.constraint()
            self.end()

    def block(self) -> None:
        self.group("{", "block")

    def role_block(self) -> None:
        if not self.lang.statements("".join(self.t[: self.n]), "block_body"):
            raise Wrong
        self.at = self.n

    def role_block_body(self) -> None:
        while not self.done():
            if self.skip(";"):
                continue
            self.statement()
            self.end()

    def expressions(self) -> None:
        self.expression()
        while self.skip(","):
            self.expression()

    def statement(self) -> None:
        if self.is_group("{"):
            self.block()
        elif self.declaration():
            pass
        elif self.on("go", "defer"):
            self.at += 1
            self.expression()
        elif self.skip("return"):
            if not (self.done() or self.on(";")):
                self.expressions()
        elif self.on("break", "continue"):
            self.at += 1
            if self.is_name():
                self.at += 1
        elif self.skip("goto"):
            self.name()
        elif self.skip("fallthrough"):
            pass
        elif self.on("if"):
            self.if_statement()
        elif self.skip("for"):
            self.in_head(self.for_head)
            self.block()
        elif self.skip("switch"):
            self.in_head(self.switch_head)
            self.group("{", "switch")
        elif self.skip("select"):
            self.group("{", "switch")
        elif self.is_name() and self.next_is(":"):
            self.at += 2
            if not (self.done() or self.on(";")):
                self.statement()
        else:
            self.simple()

    def in_head(self, step) -> None:
        before, self.head = self.head, True
        step()
        self.head = before

    def if_statement(self) -> None:
        self.need("if")

        self.in_head(self.condition)
        self.block()
        if self.skip("else"):
            if self.on("if"):
                self.if_statement()
            else:
                self.block()

    def condition(self) -> None:
        """[simple ;] expression: an assignment is no condition."""
        start = self.at
        if self.attempt(self.expression) and self.is_group("{"):
            return
        self.at = start
        if not self.on(";"):
            self.simple()
        self.need(";")
        self.expression()

    def for_head(self) -> None:
        if self.is_group("{"):
            return
        if self.skip("range"):
            self.expression()
            return
        start = self.at
        if self.attempt(self.expression) and self.is_group("{"):
            return
        self.at = start
        if not self.on(";"):
            self.simple(True)
        if self.skip(";"):
            if not self.on(";"):
                self.expression()
            self.need(";")
            if not self.is_group("{"):
                self.simple()

    def switch_head(self) -> None:
        if self.is_group("{"):
            return
        if not self.on(";"):
            self.simple()
        if self.skip(";") and not self.is_group("{"):
            self.simple()

    def role_switch(self) -> None:
        while not self.done():
            if self.skip("case"):
                if not self.attempt(self.simple, lambda: self.need(":")):
                    self.type()
                    while self.skip(","):
                        self.type()
                    self.need(":")
            else:
                self.need("default")
                self.need(":")
            while not self.done() and not self.on("case", "default"):
                if self.skip(";"):
                    continue
                self.statement()
                if not self.on("case", "default"):
                    self.end()

    def simple(self, ranged: bool = False) -> None:
        self.expressions()
        c = self.now()
        if c and c in self.assign_ops:
            self.at += 1
            if ranged and self.skip("range"):
                self.expression()
            else:
                self.expressions()
        elif self.on("++", "--"):
            self.at += 1
        elif self.skip("<-"):
            self.expression()

    def expression(self) -> None:
        self.unary()
        while self.now() and self.now() in self.binary_ops:
            self.at += 1
            self.unary()

    def unary(self) -> None:
        while self.on("+", "-", "!", "^", "*", "&", "<-"):
            self.at += 1
        self.postfix()

    def postfix(self) -> None:
        literal = self.operand()
        while True:
            if self.on("."):
                self.at += 1
                if self.is_group("("):
                    if not self.skip_group("(", "type"):
                        self.group("(", "type_switch")
                else:
                    self.name()
            elif self.is_group("("):
                self.group("(", "args")
                literal = False
            elif self.is_group("["):
                if not (self.skip_group("[", "index") or self.skip_group("[", "type_list")):
                    raise Wrong
            elif literal and not self.head and self.is_group("{") and self.lang.fits(self.now(), "literal"):
                self.at += 1
                literal = False
            else:
                return

    def operand(self) -> bool:
        """Read an operand; whether a literal's braces may follow."""
        c = self.now()
        if c in (NUMBER, STRING) and c:
            self.at += 1
            return False
        if self.is_name():
            self.at += 1
            return True
        if self.is_group("("):
            if not (self.skip_group("(", "paren") or self.skip_group("(", "type")):
                raise Wrong
            return False
        if self.on("func"):
            start = self.at
            before, self.head = self.head, False
            if not self.attempt(lambda: self.function(False)):
                self.at = start
                self.type()
            self.head = before
            return False
        if self.is_group("[") or self.on("map", "struct"):
            self.type()
            if self.is_group("{"):
                self.group("{", "literal")
            elif not self.is_group("("):
                return True
            return False
        if self.on("chan", "interface"):
            self.type()
            return False
        raise Wrong

    def role_paren(self) -> None:
        self.expression()

    def role_type_switch(self) -> None:
        self.need("type")

    def role_args(self) -> None:
        def item() -> None:
            if not self.attempt(self.expression) or not (self.done() or self.on(",", "...")):
                raise Wrong
            self.skip("...")

        def item_or_type() -> None:
            start = self.at
            try:
                item()
            except Wrong:
                self.at = start
                self.type()

        # A line end before the closing bracket has become a semicolon, which no list may hold.
        self.comma_list(item_or_type)

    def role_index(self) -> None:
        if not self.on(":"):
            self.expression()
        colons = 0
        while self.skip(":"):
            colons += 1
            if not (self.done() or self.on(":")):
                self.expression()
        if colons > 2:
            raise Wrong

    def role_literal(self) -> None:
        def part() -> None:
            if self.is_group("{"):
                self.group("{", "literal")
            else:
                self.expression()

        def item() -> None:
            part()
            if self.skip(":"):
                part()

        self.comma_list(item)


_LANGUAGES: dict[str, Language] = {}


def language(name: str) -> Language:
    if name not in _LANGUAGES:
        _LANGUAGES[name] = {"js": JavaScript, "ts": TypeScript, "java": Java, "go": Go}[name]()
    return _LANGUAGES[name]
