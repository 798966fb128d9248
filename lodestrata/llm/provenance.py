"""Generated, minified or vendored source files and data stored as code (problem 6).

Method: the words of generators' and third parties' notices are matched in all comments at a file's head by one multi-pattern
automaton (Aho-Corasick); where one occurs, a small grammar of notices decides whether a clause says it of the file. This is
combined with path rules for vendored and generated directories, lockfiles and suffixes. The shape of the text tells minified
code and data blobs. Changed copies of third-party files without a notice are found by the lines that they share with files
known to be third-party, exact copies of short ones by the hash of all their code.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import durable

#: Path segments, below the repository, that hold other people's code.
VENDORED = (
    "vendor", "vendored", "node_modules", "bower_components", "jspm_packages", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "extern",
    "site-packages", "dist-packages", "deps", "pods", "carthage", "godeps", ".venv", "venv", ".yarn", ".bundle",
)
#: Path segments that hold what tools write.
GENERATED = ("generated", "autogen", "auto_generated", "gen", "__generated__", "generated-sources", "generated-src", "dist", "__pycache__", ".next", ".nuxt", "_build")
#: Ends of file names that tools write, and names of lockfiles; an identifier may stand between name and extension.
NAME_RULES = (
    r"[._-]min\.(?:js|css|mjs|cjs)$",
    r"[._-](?:bundle|chunk|packed)\.js$",
    r"_pb2(?:_grpc)?\.pyi?$",
    r"\.pb\.(?:go|cc|h|js|ts|gw\.go)$",
    r"_(?:grpc_)?pb\.(?:js|ts|d\.ts)$",
    r"[._](?:gen|generated|g|freezed|designer|autogen)\.(?:ts|js|go|py|java|dart|cs|tsx|jsx)$",
    r"^zz_generated\.",
    r"(?:outerclass|grpc)\.java$",
    r"\.(?:map|snap|lock)$",
    r"^(?:package-lock|npm-shrinkwrap|yarn\.lock|pnpm-lock|composer\.lock|pipfile\.lock|poetry\.lock|cargo\.lock|gemfile\.lock|go\.sum)",
)
#: A directory that carries a release number is an unpacked package.
_RELEASE = r"/[^/]*[A-Za-z][^/]*-v?\d+\.\d+(?:\.\d+)*/"

#: Words of notices, in lower case; the automaton looks for all of them at once.
NOTICE_WORDS = (
    "generated", "machine-made", "machine made", "made by a tool", "do not edit", "do not modify", "do not change", "edit the template", "will be lost", "will be overwritten", "are overwritten", "are lost",
    "automatisch erzeugt", "automatisch erstellt", "automatisch generiert", "maschinell erzeugt", "nicht bearbeiten", "nicht ändern", "nicht von hand", "généré automatiquement", "ne pas modifier", "ne pas éditer",
    "generado automáticamente", "no editar", "no modificar",
    "verbatim from", "vendored from", "vendored copy of", "imported from upstream", "changes upstream", "@license", "@preserve", "copyright", "(c)", "©",
)

_SUBJECT = r"(?:(?:this|the following|diese|dieser|die|ce|este|cette)\s+)?(?:source\s+)?(?:file|code|module|source|script|document|class|datei|quelltext|fichier|archivo|código)\s+"
_IS = r"(?:(?:is|was|has been|have been|wird|wurde|est|a été|es|fue|ha sido)\s+)?"
#: What may follow when the notice speaks of the file itself, and not of something else that is generated.
_OF_FILE = r"(?=\s*$|\s*[,;:.!(<>*/-]|\s+(?:file|code|source|module|document|by|from|with|using|on|at|during|via|every|whenever|when|and|for|durch|aus|von|mit|bei|par|à|de|du|por|desde)\b)"
#: Grammar of the notices, each read from the start of a clause.
STATEMENTS = (
    ("generated", re.compile(rf"@generated\b|<auto-?generated\b|(?:{_SUBJECT}{_IS})?(?:auto(?:matically)?[- ]?generated|machine[- ](?:generated|made)|generated\s+automatically){_OF_FILE}")),
    ("generated", re.compile(rf"(?:(?:{_SUBJECT}{_IS})|{_IS})?(?:auto(?:matically)?[- ]?)?generated\s+(?:automatically\s+)?(?:by|from|with|using)\s+(?!hand\b)\S")),
    ("generated", re.compile(rf"{_SUBJECT}(?:is|was|has been)\s+(?:auto(?:matically)?[- ]?)?generated{_OF_FILE}")),
    ("generated", re.compile(r"(?:please\s+)?do not (?:edit|modify|change)(?:\s+(?:this|the)\s+(?:generated\s+)?(?:file|code|module|source))?(?:\s+it)?(?:\s+(?:manually|by hand|directly))?\s*(?:$|[.!,;*/-])")),
    ("generated", re.compile(r"(?:please\s+)?edit the template\b|(?:(?:any|all|your|manual|hand)\s+)*(?:changes|edits|modifications)(?:\s+\w+){0,6}?\s+(?:will be|are|get)\s+(?:lost|overwritten)\b|(?:made|produced|written) by a tool\b")),
    ("generated", re.compile(rf"(?:{_SUBJECT}{_IS})?(?:automatisch|maschinell)\s+(?:erzeugt|erstellt|generiert){_OF_FILE}|(?:bitte\s+)?nicht\s+(?:von hand\s+)?(?:bearbeiten|ändern)\s*(?:$|[.!,;*/-])")),
    ("generated", re.compile(rf"(?:{_SUBJECT}{_IS})?(?:généré\s+automatiquement|generado\s+automáticamente){_OF_FILE}|(?:ne pas (?:modifier|éditer)|no (?:editar|modificar))\s*(?:$|[.!,;*/-])")),
    ("vendored", re.compile(r"(?:copied|taken|imported) verbatim from \S|vendored (?:copy of|from) \S|imported from upstream\b|(?:please\s+)?send (?:all\s+|your\s+)?changes upstream\b|@preserve\b")),
    ("vendored", re.compile(r"@license\s+(?!(?:mit|isc|bsd|apache|a?gpl|lgpl|mpl|unlicense)\b)\S")),
)
#: A notice of somebody's rights, and of the terms under which others may copy; both together are a third party's.
_HOLDER = re.compile(r"(?:\(c\)|©|copyright)(?:\s*(?:\(c\)|©))?\s*\d{4}(?:\s*[-–,]\s*\d{4})*,?\s+(?:by\s+)?(?:the\s+)?([\w.@-]+(?:\s+[\w.@-]+){0,3}?)\s+(?:contributors|authors|project|developers|foundation|maintainers)\b")
_TERMS = re.compile(r"\b(?:mit|bsd|apache|gpl|lgpl|mpl|isc|licen[cs]ed?)\b")
_CLAUSE = re.compile(r"\n|(?<=[.;:!?])\s+|\s+[-–—]+\s+|\s*[|()]\s*|,\s+")
_SIGNS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*+|//+!?|#+!?|<!--|--+|;+|\"\"\"|''')\s*|\s*(?:\*/|-->|\"\"\"|''')\s*$")


@lru_cache(maxsize=1)
def _automaton():  # noqa: ANN202
    import ahocorasick

    machine = ahocorasick.Automaton()
    for words in NOTICE_WORDS:
        machine.add_word(words, words)
    machine.make_automaton()
    return machine


_LINE_COMMENT = re.compile(r"//|#|--|;|\*")
_BLOCKS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"))


def head_comments(text: str) -> list[str]:
    """The comment lines before the first line of code, in lower case: line and block comments, and a module's opening string."""
    out: list[str] = []
    at, closing = 0, ""
    text = text.removeprefix("﻿")
    while at < len(text):
        ends = [e for e in (text.find("\n", at), text.find("\r", at)) if e >= 0]
        end = min(ends) if ends else len(text)
        line = text[at:end].strip()
        at = end + 1
        if not line:
            continue
        start = 0
        if not closing:
            opened = next((b for b in _BLOCKS if line.startswith(b[0])), None)
            if opened:
                closing, start = opened[1], len(opened[0])
            elif not _LINE_COMMENT.match(line):
                break
        if closing:
            stop = line.find(closing, start)
            if stop >= 0:
                # Code may follow in the line, as in minified files.
                line, closing = line[: stop + len(closing)], ""
        out.append(" ".join(line.lower().split()))
    return out


def notice_kind(text: str, repository: str = "") -> str | None:
    """generated, vendored or None, by the notices in the head's comments.

    The automaton finds the words of notices; the grammar then tells whether a clause that begins there says it of the file.
    Clauses are read line by line, and across line ends. A copyright notice of the repository itself is none of a third party.
    """
    lines = head_comments(text)
    machine = _automaton()
    if not any(True for line in lines for _ in machine.iter(line)):
        return None
    plain = "\n".join(_SIGNS.sub("", _SIGNS.sub("", line)) for line in lines)
    joined = plain.replace("\n", " ")
    kinds = {kind for whole in (plain, joined) for clause in _CLAUSE.split(whole) for kind, statement in STATEMENTS if statement.match(clause)}
    if "generated" in kinds:
        return "generated"
    holder = _HOLDER.search(joined)
    own = {repository.lower(), *re.split(r"[-_.]", repository.lower())} if repository else set()
    if holder and holder.group(1) not in own and _TERMS.search(joined):
        kinds.add("vendored")
    return "vendored" if kinds else None


_PACKED_RUN = re.compile(r"[A-Za-z0-9+/=\\]{60,}")
_NUMBERS = re.compile(r"(?:0[xX][\da-fA-F]+|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*,")
#: Shares of white space that tell minified from hand-written code, and the evidence for the former (natural logarithm of the
#: odds). Over the 51,965 sources of sf0.1 and check_l, minified ones have 0.02 to 0.056, all others 0.08 and more, nearly all 0.15 and more.
MINIFIED_BLANKS, HAND_BLANKS, EVIDENCE = 0.04, 0.10, 6.0
#: Characters in packed runs and numbers in a table that make a data blob. There, blobs have at least 532 and 300, hand-kept
#: tables at most 50 numbers and no packed run.
PACKED_LEAST, NUMBERS_LEAST = 400, 150


def shape_kind(text: str) -> str | None:
    """data, minified or None, by the text's shape; small tables are neither.

    Code is minified if its white space is more likely at the rate of minified code by ``EVIDENCE``, so very short texts, which
    cannot give it, are not.
    """
    n = len(text)
    packed = sum(map(len, _PACKED_RUN.findall(text)))
    if packed >= PACKED_LEAST and packed > 0.6 * n:
        return "data"
    blanks = n - len("".join(text.split()))
    values = _NUMBERS.findall(text)
    if len(values) >= NUMBERS_LEAST and sum(map(len, values)) > 0.7 * (n - blanks):
        return "data"
    odds = blanks * math.log(MINIFIED_BLANKS / HAND_BLANKS) + (n - blanks) * math.log((1 - MINIFIED_BLANKS) / (1 - HAND_BLANKS))
    if odds >= EVIDENCE and packed < 0.3 * n and any(c in text for c in ";{}"):
        return "minified"
    return None


def path_kind(path: Column) -> Column:
    """vendored, generated or null, by the path alone (its first segment is the repository)."""
    below = F.lower(F.concat(F.lit("/"), F.regexp_replace(F.translate(path, "\\", "/"), r"^[^/]*/", "")))
    segments = F.split(F.regexp_replace(below, "/[^/]*$", ""), "/")
    name = F.regexp_extract(below, "[^/]*$", 0)
    return (
        F.when(F.arrays_overlap(segments, F.array(*map(F.lit, VENDORED))) | below.rlike(_RELEASE), "vendored")
        .when(F.arrays_overlap(segments, F.array(*map(F.lit, GENERATED))) | name.rlike("|".join(f"(?:{r})" for r in NAME_RULES)), "generated")
    )


#: Lines shorter than this are too common to tell where a text comes from.
LINE_LEAST = 24
#: A text is a changed copy if at least this share of its telling lines, and at least so many, stand in third-party files.
COPY_SHARE = 0.8
COPY_LINES = 8
#: Exact copies of third-party code of at least so many lines count, however long the lines are.
EXACT_LINES = 3


def telling_lines(text: str) -> list[int]:
    """Hashes of the distinct long lines of code, white space left out."""
    import xxhash

    return list({xxhash.xxh3_64_intdigest(line) - (1 << 63) for line in _lines_of_code(text) if len(line) >= LINE_LEAST})


def _lines_of_code(text: str) -> Iterator[str]:
    for line in text.splitlines():
        line = "".join(line.split())
        if line and not line.startswith(("//", "#", "*", "/*", '"')):
            yield line


def whole_code(text: str) -> int | None:
    """Hash of all lines of code, white space and comment lines left out; None if there are fewer than EXACT_LINES."""
    import xxhash

    lines = list(_lines_of_code(text))
    return xxhash.xxh3_64_intdigest("\n".join(lines)) - (1 << 63) if len(lines) >= EXACT_LINES else None


def classify(files: DataFrame) -> DataFrame:
    """(path, kind, reason) of every distinct path; kind is vendored, generated, minified, data or null (hand-written).

    files: (path, content), one row per path, content null where there is none; rows with a null path are left out.
    reason is path, notice, shape or copy. Whole texts are read; of a text, hashes of its lines are shuffled.
    """
    pathed = files.where("path IS NOT NULL").select("path", "content", path_kind(F.col("path")).alias("by_path"))

    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, reasons, lines, wholes = [], [], [], []
            for path, text, by_path in zip(*(batch.column(i).to_pylist() for i in range(3))):
                kind, reason = (by_path, "path") if by_path else (None, None)
                if kind is None and text:
                    kind, reason = notice_kind(text, re.split(r"[/\\]", path, maxsplit=1)[0]), "notice"
                    if kind is None and not path.lower().endswith(".json"):
                        kind, reason = shape_kind(text), "shape"
                    if kind is None:
                        reason = None
                kinds.append(kind)
                reasons.append(reason)
                asked = text and kind in (None, "vendored")
                lines.append(telling_lines(text) if asked else [])
                wholes.append(whole_code(text) if asked else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kinds, pa.string()), pa.array(reasons, pa.string()), pa.array(lines, pa.list_(pa.int64())), pa.array(wholes, pa.int64())], ["path", "kind", "reason", "lines", "whole"]
            )

    judged = durable(pathed.mapInArrow(inspect, "path string, kind string, reason string, lines array<long>, whole long"))
    # Distinct lines of third-party texts; map-side deduplication keeps repeated copies from being shuffled.
    known = judged.where("kind = 'vendored'").select(F.explode("lines").alias("line")).distinct().withColumn("known", F.lit(True))
    open_lines = judged.where("kind IS NULL").select("path", F.explode("lines").alias("line"))
    shared = (
        open_lines.join(known, "line", "left")
        .groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("n_known"))
        .where((F.col("n_known") >= COPY_LINES) & (F.col("n_known") >= COPY_SHARE * F.col("n")))
        .select("path", F.lit(True).alias("copied"))
    )
    wholes = judged.where("kind = 'vendored' AND whole IS NOT NULL").select("whole").distinct()
    exact = judged.where("kind IS NULL AND whole IS NOT NULL").join(wholes, "whole", "left_semi").select("path", F.lit(True).alias("copied"))
    copies = shared.unionByName(exact).distinct()
    return judged.drop("lines", "whole").join(copies, "path", "left").select(
        "path", F.when(F.col("copied"), "vendored").otherwise(F.col("kind")).alias("kind"), F.when(F.col("copied"), "copy").otherwise(F.col("reason")).alias("reason")
    )
