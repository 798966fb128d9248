import numpy as np
import pytest

from lodestrata.llm.neighbours import Codes, Lists, nearest, rotation, similar_pairs

SCHEMA = "id string, kind string, embedding array<float>, rank int"


def cloud(n, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    points = centres[rng.integers(0, 6, n)] + 0.6 * rng.standard_normal((n, dim))
    points[1::10] = points[::10][: len(points[1::10])] + 0.02 * rng.standard_normal((len(points[1::10]), dim))
    return (points * rng.uniform(0.1, 50, (n, 1))).astype(np.float32)


def frame(spark, points, kinds=None):
    return spark.createDataFrame([(f"v{i:04d}", kinds[i] if kinds else None, [float(x) for x in p], 1) for i, p in enumerate(points)], SCHEMA)


def brute(points, k, kinds=None):
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    if kinds:
        sims[np.array(kinds, object)[:, None] != np.array(kinds, object)[None, :]] = -9
    return {(i, int(j)) for i in range(len(points)) for j in np.argsort(-sims[i], kind="stable")[:k] if sims[i, j] > -5}, sims


@pytest.mark.parametrize(("probes", "members", "block"), [(1000, 4096, 4096), (1000, 17, 13)])
def test_all_lists_give_the_exact_result(spark, probes, members, block):
    points = cloud(150)
    out = nearest(frame(spark, points), 5, 16, probes=probes, members=members, block=block).collect()
    truth, sims = brute(points, 5)
    got = {(int(r.id[1:]), int(r.neighbour[1:])) for r in out}
    assert len(got & truth) >= 0.99 * len(truth) and len(out) == 150 * 5
    assert all(abs(r.similarity - sims[int(r.id[1:]), int(r.neighbour[1:])]) < 1e-5 for r in out)


def test_recall_with_few_probes(spark):
    points = cloud(400, 3)
    truth, _ = brute(points, 5)
    got = {(int(r.id[1:]), int(r.neighbour[1:])) for r in nearest(frame(spark, points), 5, 16, probes=12).collect()}
    assert len(got & truth) >= 0.9 * len(truth)


def test_fine_centroids_refine_the_coarse_ones(spark):
    """With few coarse centroids the number of lists stays, and so does the recall."""
    points = cloud(400, 3)
    truth, _ = brute(points, 5)
    got = {(int(r.id[1:]), int(r.neighbour[1:])) for r in nearest(frame(spark, points), 5, 16, probes=12, coarse=5).collect()}
    assert len(got & truth) >= 0.9 * len(truth)
    sample = np.stack([p / np.linalg.norm(p) for p in points]).astype(np.float32)
    lists = Lists(3, sample, 100_000, 40, 5)
    assert len(lists.coarse) == 5 and len(lists) == 40 and lists.cells.min() == 3 and lists.last_cell - 3 >= len(set(lists.cells.tolist()))
    centres = np.stack([lists.centre(k) for k in range(40)])
    brutal = np.argmin(((sample[:, None, :] - centres[None]) ** 2).sum(axis=2), axis=1)
    assert (lists.nearest(sample, 3)[:, 0] == brutal).mean() > 0.99


def test_pairs(spark):
    points = cloud(200, 4)
    _, sims = brute(points, 10)
    expected = {tuple(sorted((f"v{i:04d}", f"v{j:04d}"))) for i in range(200) for j in np.argsort(-sims[i])[:10] if sims[i, j] >= 0.95}
    assert {(r.id_a, r.id_b) for r in similar_pairs(frame(spark, points), 0.95, 10, 16).collect()} == expected


def test_within_kind(spark):
    points, kinds = cloud(90, 5), [["a", "b", None][i % 3] for i in range(90)]
    truth, _ = brute(points, 3, kinds)
    got = {(int(r.id[1:]), int(r.neighbour[1:])) for r in nearest(frame(spark, points, kinds), 3, 16, within_kind=True, probes=100).collect()}
    assert len(got & truth) >= 0.98 * len(truth) and all(kinds[a] == kinds[b] for a, b in got)


def test_rare_kinds_within_kind_are_exact(spark):
    points, kinds = cloud(600, 6), ["rare" if i % 50 == 0 else "" if i % 25 == 1 else None if i % 25 == 2 else "common" for i in range(600)]
    truth, _ = brute(points, 5, kinds)
    got = {(int(r.id[1:]), int(r.neighbour[1:])) for r in nearest(frame(spark, points, kinds), 5, 16, within_kind=True, probes=2).collect()}
    small = lambda pairs: {p for p in pairs if kinds[p[0]] != "common"}
    assert small(got) == small(truth) and all(kinds[a] == kinds[b] for a, b in got)


def test_every_query_within_a_large_kind_gets_k(spark):
    points = cloud(300, 7)
    out = nearest(frame(spark, points, ["a"] * 300), 25, 16, within_kind=True, probes=1, exact=10).collect()
    assert len(out) == 300 * 25


def test_unusable_vectors_and_repeats(spark):
    good = [1.0] * 4
    rows = [("a", "k", good, 1), ("a", "k", good, 1), ("b", None, [2.0] * 4, 1), ("c", "k", None, 1), ("d", "k", [], 1), ("e", "k", [1.0], 1), ("f", "k", [0.0] * 4, 1), ("g", "k", [1.0, None, 1.0, 1.0], 1),
            ("h", "k", [float("nan")] * 4, 1), ("i", "k", [float("inf")] + [1.0] * 3, 1), (None, "k", good, 1), ("j", "k", [-1.0] * 4, 1)]
    out = nearest(spark.createDataFrame(rows, SCHEMA), 10, 4).collect()
    assert {(r.id, r.neighbour) for r in out} == {(x, y) for x in "abj" for y in "abj" if x != y}
    assert {r.rank for r in out if r.id == "a"} == {1, 2}
    assert nearest(spark.createDataFrame([], SCHEMA), 3, 4).count() == 0


def test_bounds_hold_for_nearly_all_estimates():
    rng = np.random.default_rng(1)
    members, queries = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.standard_normal((2, 300, 64)))
    centre = members[:50].mean(axis=0)
    estimate, half = Codes(members.astype(np.float32), centre, rotation(64)).estimate(queries.astype(np.float32), centre, rotation(64))
    assert (np.abs(estimate - queries @ members.T) <= half).mean() > 0.97
