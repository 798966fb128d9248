"""Text cut off by field limits (problem 10).

Method: for every source, the texts' lengths (in characters and in bytes) give a discrete hazard: of the texts that reach
a length, the share that ends there. Window functions compare each length's hazard with the hazard of its neighbouring
lengths; the tests of a source are judged together with control of the false-discovery rate. A length is a limit if
its test is significant and its neighbours' hazard explains at most 1 - ``CUT_SHARE`` of the texts that end there, so that
a text of that length was cut with at least that probability. Every ending that is not provably complete is flagged at a limit.

Texts are also cut in mid-transfer, at no particular length. There, an end inside a word, sentence or code block counts
if the ending shows it; closing lines and list items are compared with the lines inside texts, which are whole: whether
lines that begin with a word close with a full stop, and with which words lines without one (titles, list items) end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import durable

#: Lengths on either side that are compared with a length.
NEIGHBOURS = 40
FALSE_DISCOVERY_RATE = 0.01
#: A length is tested if so many different texts end there.
LEAST_COUNT = 3
#: Least share of a length's texts that its neighbours' hazard does not explain, for the length to be a limit. Measured on
#: check_l and sf0.1: 0.96 and more at the lengths of limits, at most 0.92 where titles of one pattern have the same length.
CUT_SHARE = 0.95
#: A closing word is known if its rate among the closing words inside texts is at least this share of its rate among the last.
KNOWN_RATE = 0.002

#: What systems append to a text that they cut.
_MARK = re.compile(
    r"\s*(?:\.\.\.|…|truncated|cut off|cut|more|snip|snipped|continued|gekürzt|abgeschnitten|tronqué|coupé|truncado|cortado)[^\n\r]*",
    re.IGNORECASE,
)
#: No match is longer than _SIGN_MOST.
_SIGN = re.compile(r"(?:(?:read|show|see|view) more\W{0,3}|\.\.\.|…|»{2}|>{2})$", re.IGNORECASE)
_SIGN_MOST = 16
_OPENING = {"]": "[", ")": "(", ">": "<"}
#: Closing phrases that end in dots on purpose.
_TRAILING_OFF = re.compile(
    r"(?:and so on|and so forth|more to come|to be continued|etc|und so weiter|usw|fortsetzung folgt|mehr folgt|et ainsi de suite|à suivre|la question reste ouverte|y así sucesivamente|continuará|la pregunta sigue abierta|die frage bleibt offen|wait for it|hmm+|we will see|let us see)$",
    re.IGNORECASE,
)
_TERMINAL = ".!?。！？؟۔।"
#: Signs after which a text goes on as a rule; at a limit they tell a cut.
_PAUSES = ":;"
_IDENTIFIER = re.compile(r"^[^\W\d]\w*(?:_\w+|[a-z\d][A-Z]\w*)")
_CLOSERS = "\"'”’»)]}›*_"
_LIST = re.compile(r"^\s*(?:[-*+•–]|\d{1,3}[.)]|\[[ xX]\])\s+\S")
_HEADING = re.compile(r"^\s{0,3}#{1,6}\s+\S")
_SIGNED = re.compile(
    r"^(?:(?:—|–|--)\s*\S.{0,60}|(?:cheers|thanks|thank you|regards|best|best regards|kind regards|sincerely|yours|merci|cordialement|bien à vous|danke|grüße|viele grüße|gruß|mit freundlichen grüßen|saludos|gracias|un saludo|atentamente)\b[^.!?]{0,60})$",
    re.IGNORECASE,
)
_FENCE = re.compile(r"^\s*(```|~~~)", re.MULTILINE)
_WORD = re.compile(r"[^\W_][\w'’-]*")
#: The last piece of a line after a sentence's end.
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"'”’»)]*\s+")
_BARE_PATH = re.compile(r"(?:^|[\s(`])[\w-]+(?:/[\w-]+)+\.$")


def last_line(text: str) -> str:
    return re.split(r"[\n\r]", text)[-1]


def _first_word(line: str) -> str:
    found = _WORD.search(line)
    return found.group().lower() if found else ""


def _last_word(line: str) -> str:
    found = re.search(r"([^\W_][\w'’-]*)\W*$", line)
    return found.group(1).lower() if found else ""


def _closed(line: str) -> bool:
    """Whether the line ends as a sentence does."""
    core = line.rstrip().rstrip(_CLOSERS + "`").rstrip()
    return not core or core[-1] in _TERMINAL or not (core[-1].isalnum() or core[-1] in ",:;-/(\\=+<&|_[{'\"@#%$^~*`–—")


def appended_at(text: str) -> int:
    """Where what was appended to a text without closing white space begins; its length if nothing was."""
    if text.endswith("�"):
        return len(text.rstrip("�"))
    sign = _SIGN.search(text, max(0, len(text) - _SIGN_MOST))
    if sign:
        return sign.start()
    opening = _OPENING.get(text[-1:])
    at = text.rfind(opening) if opening else -1
    return at if at >= 0 and _MARK.fullmatch(text, at + 1, len(text) - 1) else len(text)


def analyse(text: str | None) -> tuple[str, str, str, int, int]:
    """(form, first word, last word, characters and bytes without what was appended).

    form: whole, cut, or one that the corpus decides: line (a closing line without a full stop), item, signed, pause.
    """
    if not text or not text.strip():
        return "whole", "", "", 0, 0
    stripped = text.rstrip()
    appended = stripped[appended_at(stripped) :]
    base = stripped[: len(stripped) - len(appended)].rstrip()
    n_chars, n_bytes = len(base), len(base.encode())
    if not appended:
        n_chars, n_bytes = len(text), len(text.encode())
    size = (n_chars, n_bytes)
    if "�" in stripped[-2:]:
        return ("cut", "", "", *size)
    if len(_FENCE.findall(base)) % 2:
        return ("cut", "", "", *size)
    if not base.strip():
        return ("whole", "", "", *size)
    line = last_line(base)
    piece = _SENTENCE.split(line)[-1].strip()
    if appended:
        if appended in ("...", "…") and (_TRAILING_OFF.search(piece) or _closed(base)):
            return ("whole", "", "", *size)
        return ("whole" if _closed(base) and not base.endswith("`") else "cut", "", "", *size)
    if re.match(r"^\s*(```|~~~)\s*$", line):
        return ("whole", "", "", *size)
    first, last = _first_word(piece), _last_word(piece)
    if base.endswith("`"):
        # A code name on its own after a sentence is whole; inside a sentence it is not its end.
        alone = re.fullmatch(r"`[^`]+`", piece) is not None
        return ("whole" if alone else "cut", first, last, *size)
    if line.count("`") % 2 and "```" not in line:
        return ("cut", first, last, *size)
    if _BARE_PATH.search(line) or base[-1] in _PAUSES:
        return ("pause", first, last, *size)
    if re.fullmatch(r"\([^()]*\)", piece):
        return ("whole", first, last, *size)
    if _closed(base):
        opened = line.rfind("(") > line.rfind(")") and base[-1] not in ".!?"
        return ("cut" if opened else "whole", first, last, *size)
    if _LIST.match(line):
        return ("item", first, last, *size)
    if _HEADING.match(line):
        return ("line", "#", last, *size)
    if _SIGNED.match(piece):
        return ("signed", first, last, *size)
    if piece != line.strip():
        # An open piece after a whole sentence of the same line is a sentence that has begun.
        return ("cut", first, last, *size)
    if base[-1] in ",-/(\\=+<&|[{@–—" or _IDENTIFIER.match(piece) and len(piece.split()) > 2:
        return ("cut", first, last, *size)
    return ("line", first, last, *size)


def inner_lines(text: str) -> Iterator[tuple[str, str, str]]:
    """(role, word, '') facts of the whole lines inside a text: how lines that begin with a word end, and with what."""
    in_code = False
    lines = re.split(r"[\n\r]+", text.rstrip())
    for line in lines[:-1]:
        if _FENCE.match(line):
            in_code = not in_code
            continue
        if in_code or not line.strip():
            continue
        closed = _closed(line)
        if not _LIST.match(line) and not _HEADING.match(line):
            word = _first_word(line)
            if word:
                yield ("begins_closed" if closed else "begins_open"), word, ""
        if not closed:
            word = _last_word(line)
            if word:
                yield "ends_open", word, ""


_PARSED = "doc_id long, source string, form string, first string, last string, n_chars int, n_bytes int, base_chars int, base_bytes int, body long, role string, word string, n long"


def parse(documents: DataFrame) -> DataFrame:
    """Each text read once: a row per document with its ending (role null), and counts (role, word, n) of the lines inside texts.

    The counts are those of one Arrow batch each; rows are not moved.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        string, small, long = pa.string(), pa.int32(), pa.int64()
        kinds = [long, string, string, string, string, small, small, small, small, long, string, string, long]
        names = [part.split()[0] for part in _PARSED.split(", ")]
        for batch in batches:
            counts: Counter = Counter()
            rows = []
            for doc_id, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                form, first, last, chars, size = analyse(text)
                raw = (text or "").encode()
                rows.append((doc_id, source, form, first, last, len(text or ""), len(raw), chars, size, xxhash.xxh3_64_intdigest(raw) - (1 << 63), None, None, None))
                if text:
                    counts.update((role, word) for role, word, _ in inner_lines(text))
                if form in ("line", "item") and last:
                    counts["ends_text", last] += 1
            rows.extend((None,) * 10 + (role, word, n) for (role, word), n in counts.items())
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return documents.select("doc_id", "source", "text").mapInArrow(run, _PARSED)


def endings(parsed: DataFrame) -> DataFrame:
    """One row per document with the form of its ending and its lengths."""
    return parsed.where("role IS NULL").drop("role", "word", "n")


ROLES = ("begins_closed", "begins_open", "ends_open", "ends_text")


def line_facts(parsed: DataFrame) -> DataFrame:
    """(word, begins_closed, begins_open, ends_open, ends_text): counts over the lines inside all documents and their closing lines."""
    total = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("n"))), F.lit(0)).alias(role)
    return parsed.where("role IS NOT NULL").groupBy("word").agg(*map(total, ROLES))


def length_hazards(ends: DataFrame) -> DataFrame:
    """(source, measure, length, n, at_risk, hazard, near_hazard, expected, cut_share, p_bound, significant, is_limit) of every length that occurs.

    Copies of a text count once. measure: n_chars and n_bytes of all texts, base_chars and base_bytes of those to which a
    mark was appended, without it. near_hazard: ends per text at risk over the lengths up to NEIGHBOURS away, the length itself
    left out. p_bound: an upper bound (Chernoff) of the binomial probability that, of the texts at risk, at least n end
    here by that hazard. significant: by Benjamini and Hochberg's rule among the lengths of one source and measure.
    cut_share: the part of n that near_hazard does not explain. A null source is a source of its own.

    A family has a row per length that occurs, not per text, so its window stays small however many texts a source has.
    """
    of = lambda m, held: F.struct(F.lit(m).alias("measure"), F.when(held, F.col(m)).alias("length"))
    marked = F.col("base_bytes") < F.col("n_bytes")
    measures = F.explode(F.array(of("n_chars", F.lit(True)), of("n_bytes", F.lit(True)), of("base_chars", marked), of("base_bytes", marked)))
    different = ends.where("base_chars > 0").select("source", "body", "n_chars", "n_bytes", "base_chars", "base_bytes").distinct()
    counts = different.select("source", measures.alias("m")).where("m.length IS NOT NULL").groupBy("source", "m.measure", "m.length").agg(F.count(F.lit(1)).alias("n"))
    family = Window.partitionBy("source", "measure")
    reach = family.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = family.orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    beyond = family.orderBy("length").rangeBetween(NEIGHBOURS + 1, Window.unboundedFollowing)
    n, length = F.col("n").cast("double"), F.col("length").cast("double")
    with_risk = counts.withColumns({
        "at_risk": F.sum("n").over(reach), "ended": F.sum("n").over(near), "reached": F.sum(n * length).over(near), "later": F.coalesce(F.sum("n").over(beyond), F.lit(0)),
    })
    # Each text is at risk at every length up to its own.
    low = F.greatest(F.lit(1.0), length - NEIGHBOURS)
    exposure = F.col("reached") - (low - 1) * F.col("ended") + F.col("later") * (length + NEIGHBOURS - low + 1) - F.col("at_risk")
    near_hazard = (F.col("ended") - F.col("n") + 1) / (exposure + 2)
    risk, h = F.col("at_risk").cast("double"), F.col("near_hazard")
    rest = risk - n
    log_p = n * F.log(risk * h / n) + F.when(rest > 0, rest * F.log(risk * (1 - h) / rest)).otherwise(0.0)
    tested = (
        with_risk.withColumn("near_hazard", F.least(near_hazard, F.lit(0.999)))
        .withColumn("expected", risk * h)
        .withColumn("p_bound", F.when(n > F.col("expected"), F.exp(log_p)).otherwise(1.0))
    )
    by_p = family.orderBy("p_bound", "length")
    ranked = tested.withColumns({"place": F.row_number().over(by_p), "tests": F.count(F.lit(1)).over(family)})
    passed = F.max(F.when(F.col("p_bound") <= F.col("place") / F.col("tests") * FALSE_DISCOVERY_RATE, F.col("p_bound"))).over(family)
    significant = F.coalesce((F.col("p_bound") <= F.col("limit_p")) & (F.col("n") >= LEAST_COUNT), F.lit(False))
    cut_share = F.greatest(F.lit(0.0), 1 - F.col("expected") / n)
    return ranked.withColumn("limit_p", passed).select(
        "source", "measure", "length", "n", "at_risk", (n / risk).alias("hazard"), "near_hazard", "expected", cut_share.alias("cut_share"), "p_bound",
        significant.alias("significant"), (significant & (cut_share >= CUT_SHARE)).alias("is_limit"),
    )


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, form, at_limit, truncated) of every document.

    documents: (doc_id long, source string, text string). Null, empty and blank texts are not truncated. Whole texts
    are read; statistics cover all documents.
    """
    parsed = durable(parse(documents))
    ends, facts = endings(parsed), line_facts(parsed)
    limits = length_hazards(ends).where("is_limit AND measure IN ('n_chars', 'n_bytes')")
    plain = ends.where("form IN ('whole', 'cut')")
    asked = ends.where("form NOT IN ('whole', 'cut')")
    both = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in ("n_chars", "n_bytes")]))
    at_limit = (
        asked.select("doc_id", "source", both.alias("m"))
        .join(limits.select(F.col("source").alias("s"), F.col("measure").alias("mm"), F.col("length").alias("ll")), (F.col("source").eqNullSafe(F.col("s"))) & (F.col("m.measure") == F.col("mm")) & (F.col("m.length") == F.col("ll")), "left_semi")
        .select("doc_id").distinct().withColumn("at_limit", F.lit(True))
    )
    begins = facts.select(F.col("word").alias("first"), "begins_closed", "begins_open")
    finals = facts.select(F.col("word").alias("last"), "ends_open", "ends_text")
    sums = facts.agg(F.sum("ends_open").alias("inner_ends"), F.sum("ends_text").alias("text_ends"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    # Rates, so that a slip inside one of very many texts makes no word known.
    known_end = (zero("ends_open") > 0) & (zero("ends_open") * zero("text_ends") >= KNOWN_RATE * zero("ends_text") * zero("inner_ends"))
    sentence = zero("begins_closed") > 2 * zero("begins_open")
    near = F.coalesce("at_limit", F.lit(False))
    verdict = near | F.when(F.col("form") == "line", sentence | ~known_end).when(F.col("form") == "item", ~known_end).otherwise(False)
    judged = (
        asked.join(at_limit, "doc_id", "left").join(begins, "first", "left").join(finals, "last", "left").crossJoin(sums)
        .select("doc_id", "source", "form", near.alias("at_limit"), verdict.alias("truncated"))
    )
    return plain.select("doc_id", "source", "form", F.lit(None).cast("boolean").alias("at_limit"), (F.col("form") == "cut").alias("truncated")).unionByName(judged)


def shares(judged: DataFrame) -> DataFrame:
    """Per source: number of documents, of truncated ones and their share."""
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("truncated").alias("n_truncated")).withColumn(
        "share", F.col("n_truncated") / F.col("n_documents")
    )
