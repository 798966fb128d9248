import random

import pytest

from lodestrata.llm import truncation as tr


@pytest.mark.parametrize(
    ("text", "form"),
    [
        (None, "whole"), ("", "whole"), (" \n", "whole"), ("All done.", "whole"), ("Really?", "whole"), ("状態は ok です。", "whole"), ("Done ✅", "whole"), ("It works. (see core/a.py)", "whole"), ("It works.\n\n`run()`", "whole"), ("```\nx\n```", "whole"),
        ("A sentence. And so on...", "whole"), ("Satz. Und so weiter…", "whole"), ("He said \"no.\"", "whole"), ("Fine. Thanks!\n", "whole"),
        ("A sentence ends. Another beg", "cut"), ("It ends with a half wor�", "cut"), ("It was cut her...", "cut"), ("It was cut [...]", "cut"), ("It was cut at (truncated)", "cut"), ("```js\nlet a = 1;\n", "cut"), ("```js\nlet a = 1;\n}", "cut"), ("If the `key", "cut"),
        ("A full one. It waits for the lock,", "cut"), ("If the cache is gone, `load`", "cut"), ("parse_items still reads the", "cut"), ("A full one. It holds (see the", "cut"),
        ("- one\n- two items", "item"), ("Rename old parts", "line"), ("Text.\n\nCheers, the core crew", "signed"), ("Text. — das Team core", "signed"), ("It reads core/files.", "pause"), ("It comes in two parts:", "pause"), ("# A heading", "line"),
    ],
)
def test_forms(text, form):
    assert tr.analyse(text)[0] == form


def test_lengths_without_what_was_appended():
    assert tr.analyse("ä" * 10 + " end of...")[3:] == (17, 27)
    assert tr.analyse("abc def")[3:] == (7, 7)


SCHEMA = "doc_id long, source string, text string, form string"


def corpus(n=900, limit=120, seed=1):
    """Prose from three sources, one of which cuts at a limit; titles and lists that are whole."""
    r = random.Random(seed)
    nouns, verbs = ["cache", "queue", "index", "ledger", "socket", "vector"], ["reads", "writes", "drops", "keeps"]
    rows, cut = [], set()
    for i in range(n):
        source = r.choice(["a", "b", None])
        kind = r.random()
        if kind < 0.1:
            text = f"Rename {r.choice(nouns)} before {r.choice(nouns)}"
        elif kind < 0.2:
            text = "\n".join(f"- {r.choice(nouns)} {r.choice(nouns)}" for _ in range(r.randrange(2, 6)))
        else:
            text = f"Rename {r.choice(nouns)} before {r.choice(nouns)}\n\n- {r.choice(nouns)}\n- {r.choice(nouns)} {r.choice(nouns)}\n\n" * (kind > 0.8)
            text += " ".join(f"The {r.choice(nouns)} {r.choice(verbs)} every {r.choice(nouns)} after {r.randrange(99)} days." for _ in range(r.randrange(1, 6)))
        if source == "a" and len(text) > limit:
            text = text[:limit]
            if text[-1] not in ".":
                cut.add(i)
        rows.append((i, source, text, "f"))
    return rows, cut


def test_limits_and_cut_texts_are_found(spark):
    rows, cut = corpus()
    frame = spark.createDataFrame(rows, SCHEMA)
    limits = tr.length_hazards(tr.endings(tr.parse(frame))).where("is_limit AND measure = 'n_chars'").collect()
    assert ("a", 120) in {(r.source, r.length) for r in limits} and {r.source for r in limits if r.n > 20} == {"a"}
    got = {r.doc_id for r in tr.truncated(frame).where("truncated").collect()}
    assert len(got & cut) >= 0.97 * len(cut) and len(got - cut) <= 0.02 * len(rows)
    shares = {r.source: r.n_truncated for r in tr.shares(tr.truncated(frame)).collect()}
    assert set(shares) == {"a", "b", None} and shares["b"] <= 3


def test_every_document_has_one_row(spark):
    rows = [(1, None, None, "f"), (2, "s", "", "f"), (3, "s", "Whole.", "f"), (3, "s", "Whole.", "f"), (4, "s", "word " * 200_000 + "end", "f"), (None, "s", "It is cut her...", "f")]
    out = tr.truncated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 1, 2, 3, 3, 4]
    assert {r.doc_id for r in out if r.truncated} == {None, 4}
    assert tr.truncated(spark.createDataFrame([], SCHEMA)).count() == 0


def hazards_by_hand(lengths, size=tr.NEIGHBOURS):
    out = {}
    for at in set(lengths):
        risk = sum(x >= at for x in lengths)
        ends = sum(abs(x - at) <= size and x != at for x in lengths)
        exposure = sum(sum(x >= k for x in lengths) for k in range(max(1, at - size), at + size + 1) if k != at)
        out[at] = (risk, (ends + 1) / (exposure + 2))
    return out


def test_hazards_equal_counting(spark):
    r = random.Random(3)
    texts = ["x" * r.randrange(1, 160) + str(k) for k in range(300)]
    rows = [(k, None, t, "f") for k, t in enumerate(texts)] + [(999, None, texts[0], "f")]
    got = {h.length: (h.at_risk, h.near_hazard) for h in tr.length_hazards(tr.endings(tr.parse(spark.createDataFrame(rows, SCHEMA)))).where("measure = 'n_chars'").collect()}
    want = hazards_by_hand([len(t) for t in texts])
    assert set(got) == set(want)
    for length, (risk, hazard) in want.items():
        assert got[length][0] == risk and abs(got[length][1] - min(hazard, 0.999)) < 1e-9


def test_a_limit_decides_every_open_ending(spark):
    """Signatures, items and pauses of a common last word are whole at any length, but not at a limit."""
    r = random.Random(5)
    word = lambda: r.choice(["cache", "queue", "index", "ledger"])
    rows = []
    for i in range(400):
        inner = f"- {word()} cache\n- the {word()}\n\n"
        body = inner + " ".join(f"The {word()} keeps every {word()} after {r.randrange(999)} days." for _ in range(1 + i % 9))
        rows.append((i, "cutter" if i < 200 else "other", body[:300] if i < 200 else body, "f"))
    def padded(end, size=300):
        start = "Fine words stand here " * 40
        return start[: size - len(end) - 2] + "." + "\n" + end
    for k, end in enumerate(("- the cache", "Cheers, the cache", "It comes in two parts:")):
        rows.append((1000 + k, "cutter", padded(end), "f"))
        rows.append((2000 + k, "other", padded(end, 290), "f"))
    got = {r.doc_id for r in tr.truncated(spark.createDataFrame(rows, SCHEMA)).where("truncated").collect()}
    assert {1000, 1001, 1002} <= got and not got & {2000, 2001, 2002}


@pytest.mark.parametrize(("text", "at"), [("a [truncated: " + "x" * 300 + "]", 2), ("a b", 3), ("a...", 1), ("a��", 1), ("a (see b)", 9), ("a <cut>", 2), ("", 0)])
def test_where_marks_begin(text, at):
    assert tr.appended_at(text) == at
