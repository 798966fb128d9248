"""Lexers of the source languages: tokens, token classes, and the summaries of text chunks.

A chunk's summary says, for each lexer state in which the chunk may begin, in which state it ends and which brackets
stay open or close something before it. Summaries combine associatively, so chunks of one file can be summarised
anywhere and reduced in any grouping.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

CODE = "code"
#: Characters of a chunk; chunks end at line ends.
CHUNK = 1 << 18

_SPACE = r"(?:[^\S\n\r]+|//[^\n\r]*|/\*[^\n\r*]*(?:\*(?!/)[^\n\r*]*)*\*/)*"
_NEWLINE = r"[\n\r]\s*"
_BLOCK = r"/\*[\s\S]*?\*/"
_OPEN_BLOCK = r"/\*[\s\S]*"
_DOUBLE = r'"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"'
_SINGLE = r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"
_C_NUMBER = r"(?:0[xXbBoO][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[nLlfFdDi]?(?![\w$])"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`"
#: A slash begins a regular expression where no value stands before it; after a closing parenthesis the text decides (``tokenize``).
_REGEX = r"(?:(?<=[(,=:\[!&|?{};\n])|(?<=[(,=:\[!&|?{};>] )|(?<=return ))/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n\r])*\]|[^/\\\n\r\[])+/[a-z]*"

#: Token patterns; the first group is the token. The last alternative takes any character that begins no token.
TOKENS = {
    "js": re.compile(
        rf"{_SPACE}((?:[^\W\d]|\$)[\w$]*|{_NEWLINE}|{_BLOCK}|{_DOUBLE}|{_SINGLE}|{_TEMPLATE}|{_C_NUMBER}|{_REGEX}|{_OPEN_BLOCK}|`[\s\S]*|#(?:[^\W\d]|\$)[\w$]*"
        r"|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]|[\s\S]|$)"
    ),
    "java": re.compile(
        rf'{_SPACE}((?:[^\W\d]|\$)[\w$]*|{_NEWLINE}|{_BLOCK}|"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|"""[\s\S]*|{_DOUBLE}|{_SINGLE}|{_C_NUMBER}|{_OPEN_BLOCK}'
        r"|\.\.\.|<<=|>>=|>>>=|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@]|[\s\S]|$)"
    ),
    "go": re.compile(
        rf"{_SPACE}([^\W\d]\w*|{_NEWLINE}|{_BLOCK}|{_DOUBLE}|{_SINGLE}|`[^`]*`|`[\s\S]*|{_C_NUMBER}|{_OPEN_BLOCK}"
        r"|\.\.\.|<<=|>>=|&\^=|:=|<-|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[{}()\[\];,<>+\-*/%&|^!~:=.]|[\s\S]|$)"
    ),
    "py": re.compile(
        r"(?:[^\S\n\r]+|#[^\n\r]*|\\(?:\r\n|[\n\r]))*("
        r"(?:[rRbBuUfFtT]{0,2})(?:'''(?:[^\\]|\\[\s\S])*?'''|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\")"
        r"|(?:[rRbBuUfFtT]{0,2})(?:'''[\s\S]*|\"\"\"[\s\S]*)"
        rf"|(?:[rRbBuUfFtT]{{0,2}})(?:{_DOUBLE}|{_SINGLE})"
        r"|[^\W\d]\w*|[\n\r](?:[^\S\n\r]*(?:#[^\n\r]*)?[\n\r])*[^\S\n\r]*"
        r"|(?:0[xXbBoO][\da-fA-F_]+|(?:[1-9][\d_]*|0[0_]*(?![\d]))(?:\.[\d_]*)?(?:[eE][+-]?\d+)?[jJ]?|\d[\d_]*\.[\d_]*(?:[eE][+-]?\d+)?[jJ]?|\.\d[\d_]*(?:[eE][+-]?\d+)?[jJ]?)(?!\w)"
        r"|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[{}()\[\];,<>+\-*/%&|^~:=.@]|[\s\S]|$)"
    ),
    "json": re.compile(r'[ \t\n\r]*("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true|false|null|[{}\[\],:]|[\s\S]|$)'),
}
#: The same with regular expressions after closing parentheses, as in ``if (x) /y/.test(z)``.
_AFTER_HEAD = re.compile(TOKENS["js"].pattern.replace(r"(?<=return ))/", r"(?<=return )|(?<=\))|(?<=\) ))/"))
TOKENS["ts"] = TOKENS["js"]

#: Lexer states that last over a line end, and what is left of them: their text up to their end.
_RESTS = {
    "block": re.compile(r"[\s\S]*?\*/"),
    "raw": re.compile(r"[^`]*`"),
    "text": re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'),
    "single": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"),
    "double": re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'),
}
#: Templates nest, so their state is the stack of what is open: ` for a template's text, { for code in it.
TEMPLATE = "`"
_STATES = {"js": ("block", TEMPLATE, "`{"), "ts": ("block", TEMPLATE, "`{"), "java": ("block", "text"), "go": ("block", "raw"), "py": ("single", "double"), "json": ()}
_IN_TEMPLATE = re.compile(r"\\[\s\S]|`|\$\{")
_IN_CODE = re.compile(r"\"(?:[^\"\\\n\r]|\\[\s\S])*\"|'(?:[^'\\\n\r]|\\[\s\S])*'|//[^\n\r]*|/\*[\s\S]*?\*/|[`{}]")


def scan_template(text: str, at: int, stack: str) -> tuple[int, str]:
    """(end, '') of a template whose open parts are ``stack`` at a place, or (length, what is still open)."""
    open_ = list(stack)
    while open_:
        found = (_IN_TEMPLATE if open_[-1] == "`" else _IN_CODE).search(text, at)
        if not found:
            return len(text), "".join(open_)
        at = found.end()
        sign = found.group()
        if open_[-1] == "`":
            if sign == "`":
                open_.pop()
            elif sign == "${":
                open_.append("{")
        elif sign in ("`", "{"):
            open_.append(sign)
        elif sign == "}":
            open_.pop()
    return at, ""


def rest_of(text: str, state: str) -> tuple[int, str]:
    """(place after the literal or comment in whose ``state`` a text begins, state there: code, or what is still open)."""
    if state.startswith("`"):
        end, left = scan_template(text, 0, state)
        return end, left or CODE
    found = _RESTS[state].match(text)
    return (found.end(), CODE) if found else (len(text), state)


_PAIR = {")": "(", "]": "[", "}": "{"}


@dataclass(frozen=True)
class Span:
    """What a stretch of text does from one start state: end state, closers of brackets before it, brackets left open."""

    end: str
    closers: str = ""
    openers: str = ""
    broken: bool = False

    def then(self, other: Span) -> Span:
        left, right = self.openers, other.closers
        n = min(len(left), len(right))
        wrong = any(_PAIR[c] != o for c, o in zip(right[:n], reversed(left)))
        return Span(other.end, self.closers + right[n:], left[: len(left) - n] + other.openers, self.broken or other.broken or wrong)

    @property
    def balanced(self) -> bool:
        return self.end == CODE and not (self.closers or self.openers or self.broken)


_OPENINGS = {"py": {"'''": "single", '"""': "double"}, "java": {'"""': "text"}}


def open_state(token: str, lang: str) -> str | None:
    """The state in which a token that takes the rest of the text leaves the lexer; None if the token is whole."""
    if lang in ("py", "java"):
        body = token.lstrip("rRbBuUfFtT") if lang == "py" else token
        state = _OPENINGS[lang].get(body[:3])
        if state:
            end, left = rest_of(body[3:], state)
            return None if left == CODE and end == len(body) - 3 else state
    if lang == "py":
        return None
    if token.startswith("/*"):
        return None if len(token) >= 4 and token.endswith("*/") else "block"
    if token.startswith("`"):
        if lang == "go":
            return None if len(token) >= 2 and token.endswith("`") else "raw"
        return scan_template(token, 1, TEMPLATE)[1] or None
    return None


LOST = Span("lost", broken=True)
_BRACKETS = frozenset("()[]{}")


def span_of(tokens: list[str], lang: str) -> Span:
    """The span of tokens that were read from the code state."""
    closers, openers, broken = [], [], False
    for token in tokens:
        if token in _BRACKETS:
            if token in "([{":
                openers.append(token)
            elif openers:
                broken |= openers.pop() != _PAIR[token]
            else:
                closers.append(token)
    state = open_state(tokens[-1], lang) if tokens else None
    return Span(state or CODE, "".join(closers), "".join(openers), broken)


def tokenize(text: str, lang: str, after_head: bool = False) -> list[str]:
    """The tokens of a text that begins in the code state; the last may be a literal or comment that it leaves open.

    after_head: a slash after a closing parenthesis begins a regular expression (JavaScript and TypeScript).
    """
    pattern = _AFTER_HEAD if after_head else TOKENS[lang]
    tokens = pattern.findall(text)
    while tokens and not tokens[-1]:
        tokens.pop()
    if lang in ("js", "ts"):
        # A template with code in it that the pattern cannot span took the rest of the text.
        while tokens and tokens[-1][0] == "`" and len(tokens[-1]) > 1:
            start = len(text) - len(tokens[-1])
            end, left = scan_template(text, start + 1, TEMPLATE)
            if left or end == len(text):
                break
            tokens[-1] = text[start:end]
            tokens += pattern.findall(text, end)
            while tokens and not tokens[-1]:
                tokens.pop()
    return tokens


@dataclass
class Chunk:
    """A chunk's lexer-state map: for a state in which it may begin, its span, its tokens, and how much ends the literal before."""

    text: str
    lang: str
    after_head: bool = False

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[Span, list[str], int]] = {}

    def at(self, state: str) -> tuple[Span, list[str], int]:
        if state not in self.known:
            end, left = (0, CODE) if state == CODE else rest_of(self.text, state)
            tokens = [] if left != CODE else tokenize(self.text[end:], self.lang, self.after_head)
            self.known[state] = (Span(left) if left != CODE else span_of(tokens, self.lang), tokens, end)
        return self.known[state]

    def spans(self) -> dict[str, Span]:
        return {state: self.at(state)[0] for state in (CODE, *_STATES[self.lang])}


def summarize(chunk: str, lang: str) -> dict[str, Span]:
    """The chunk's lexer-state map: its span for every state in which it may begin."""
    return Chunk(chunk, lang).spans()


def combine(left: dict[str, Span], right: dict[str, Span]) -> dict[str, Span]:
    """The map of two stretches that follow one another; associative.

    A template that is open more than once over at the border is in no map; what follows is then lost, and counts as broken.
    ``lex``, which makes a map's entries as they are asked for, does not lose it.
    """
    out = {}
    for state, span in left.items():
        onward = right.get(span.end, LOST)
        out[state] = LOST if onward.end == LOST.end else span.then(onward)
    return out


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """The text in chunks of at least ``size`` characters; all but the first begin with a line end (not of a continued line)."""
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at + max(size, 1))
        while end > 0 and text[end - 1] == "\\" or end > 1 and text[end - 2 : end] == "\\\r":
            end = text.find("\n", end + 1)
        if end > 0 and text[end - 1] == "\r":
            end -= 1
        end = len(text) if end <= at else end
        out.append(text[at:end])
        at = end
    return out or [""]


def lex(text: str, lang: str, size: int = CHUNK, after_head: bool = False) -> tuple[Span, list[str]]:
    """(span, tokens) of a whole text, reduced over its chunks.

    The reduction goes from left to right here, so a chunk's map is made only for the state in which the chunk begins.
    """
    total, tokens = Span(CODE), []
    for piece in chunks(text, size):
        begin = total.end
        span, more, end = Chunk(piece, lang, after_head).at(begin)
        if begin != CODE and tokens:
            tokens[-1] += piece[:end]
        tokens += more
        total = total.then(span)
    return total, tokens


def file_span(text: str, lang: str, size: int = CHUNK) -> Span:
    """The span of a whole text, reduced over its chunks."""
    return lex(text, lang, size)[0]
