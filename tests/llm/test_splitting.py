import random

import pytest

from lodestrata.llm.splitting import cut_points, landmarks, line_starts, split_items


def source(n, seed=0, end="\n"):
    r = random.Random(seed)
    return end.join("".join(r.choice("abcdefgh ijkl;äö🙂") for _ in range(r.randrange(0, 90))) for _ in range(n))


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_pieces_cover_the_text_and_keep_the_limit(end):
    text = source(400, 1, end)
    cuts = cut_points(text, [50, 51, 120, 9999, 0], 4000, 200, 1000)
    ends = [e for e, _ in cuts]
    assert ends == sorted(set(ends)) and ends[-1] == len(text)
    at = 0
    for k, (stop, kind) in enumerate(cuts):
        assert stop - max(0, at - 200 if k else 0) <= 4000
        assert kind in ("symbol", "line", "end") and (kind == "end" or stop in line_starts(text))
        at = stop


def test_symbol_boundaries_are_preferred():
    text = "\n".join("x" * 40 for _ in range(300))
    boundaries = list(range(1, 300, 7))
    kinds = [k for _, k in cut_points(text, boundaries, 4000, 0, 1000)]
    assert set(kinds[:-1]) == {"symbol"}


def test_text_without_boundaries_is_cut_hard():
    cuts = cut_points("y" * 10_000, [], 4000, 100, 1000)
    assert {k for _, k in cuts[:-1]} == {"hard"} and cuts[-1][0] == 10_000


def test_an_edit_alters_only_nearby_pieces():
    text = source(2000, 5)
    changed = text[:30_000] + "ZZZZ" + text[30_000:]
    a = {text[p:q] for p, q in zip([0, *[e for e, _ in cut_points(text, [], 4000, 0, 500)]], [e for e, _ in cut_points(text, [], 4000, 0, 500)])}
    b = {changed[p:q] for p, q in zip([0, *[e for e, _ in cut_points(changed, [], 4000, 0, 500)]], [e for e, _ in cut_points(changed, [], 4000, 0, 500)])}
    assert len(a - b) <= max(4, len(a) // 4)


def test_landmarks_depend_on_the_window_alone():
    text = source(100, 7)
    one, two = set(landmarks(text, 64)), {m + 500 for m in landmarks(text[500:], 64)}
    assert {m for m in one if m > 540} == {m for m in two if m > 540}


def test_frame_and_edge_cases(spark):
    long = source(600, 2)
    rows = [(1, long, [3, 90, None]), (2, None, None), (3, "", []), (4, "short", None), (1, long, [3, 90, None]), (None, "x" * 9000, None)]
    frame = spark.createDataFrame([(*r, "t", 9) for r in rows], "item long, content string, boundary_lines array<int>, text string, piece int")
    out = split_items(frame).collect()
    pieces = sorted({(r.piece, r.start, r.finish, r.text) for r in out if r.item == 1})
    assert pieces[0][1] == 0 and all(len(t) == f - s <= 4000 for _, s, f, t in pieces)
    assert all(b[1] == a[2] - 200 for a, b in zip(pieces, pieces[1:]))
    assert pieces[0][3] + "".join(p[3][200:] for p in pieces[1:]) == long
    assert sum(r.item == 1 for r in out) == 2 * len(pieces)
    assert [(r.item, r.piece, r.text) for r in out if r.item in (2, 3, 4)] == [(3, 0, ""), (4, 0, "short")]
    assert {r.boundary for r in out if r.item is None} == {"hard", "end"}
    assert split_items(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_items(frame, 100, 100)
