import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators.hierarchy import Forest, ancestor_pairs, circles, cycles, hierarchies, name_links, roots
from lodestrata.plans import problems

LINKS = "group string, id long, name string, parent_id long, depth int"


def frame(spark, links):
    return spark.createDataFrame([("f", i, f"n{i}", p, 7) for i, p in links.items()], LINKS)


def brute(links):
    pairs = {}
    for node in links:
        at, steps, seen = node, 0, set()
        while (up := links.get(at)) is not None and up in links and up not in seen:
            steps += 1
            seen.add(up)
            pairs[node, up] = steps
            at = up
    return pairs


def random_forest(n, seed, with_cycles):
    r = random.Random(seed)
    links = {i: (r.randrange(n) if with_cycles else r.randrange(i)) if i and r.random() < 0.85 else None for i in range(n)}
    links[n - 1] = 10 * n  # a parent that does not exist
    return links


@pytest.mark.parametrize(("seed", "with_cycles", "parts"), [(1, False, 1), (2, True, 1), (3, False, 4), (4, True, 4), (5, True, 10), (6, True, 25), (7, True, 6), (8, False, 30)])
def test_pairs_equal_brute_force(spark, seed, with_cycles, parts):
    links = random_forest(30, seed, with_cycles)
    got = {(r.id, r.ancestor): r.distance for r in ancestor_pairs(frame(spark, links), parts).collect()}
    assert got == brute(links)


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_roots_depths_and_paths(spark, parts):
    links = random_forest(40, 9, False) | {100: 101, 101: 102, 102: 100, 103: 100, 104: 104}
    pairs = brute(links)
    rows = {r.id: r for r in hierarchies(frame(spark, links), parts).collect()}
    assert set(rows) == set(links)
    for node in links:
        up = sorted((d, a) for (n, a), d in pairs.items() if n == node)
        row = rows[node]
        if node in (100, 101, 102, 103, 104):
            assert row.cyclic and row.root is None and row.path is None
        else:
            chain = [a for _, a in up]
            assert not row.cyclic and row.depth == len(chain) and row.root == (chain[-1] if chain else node)
            assert row.path == "/".join(f"n{i}" for i in [*reversed(chain), node])
        assert row.n_descendants == sum(1 for _, a in pairs if a == node)


def test_long_chain_over_many_parts(spark):
    links = {i: i - 1 if i else None for i in range(40)}
    rows = {r.id: r for r in hierarchies(frame(spark, links), 10).collect()}
    assert rows[39].depth == 39 and rows[39].root == 0 and rows[0].n_descendants == 39


def test_roots_of_a_chain_of_100000_in_any_order(spark):
    """Nearly every link leads into another stretch; circles of any length are told apart."""
    n = 100_000
    order = list(range(n))
    random.Random(4).shuffle(order)
    links = [("f", order[k], "n", order[k - 1] if k else None, 7) for k in range(n)]
    links += [("f", n + k, "n", n + (k + 1) % 999, 7) for k in range(999)] + [("f", 2 * n, "n", n, 7)]
    got = roots(spark.createDataFrame(links, LINKS), 16)
    summary = got.agg(F.count("*").alias("rows"), F.count_if("cyclic").alias("cyclic"), F.count_distinct("root").alias("roots"), F.min("root").alias("root"), F.max("depth").alias("deepest"), F.count_distinct("depth").alias("depths")).first()
    assert tuple(summary) == (n + 1000, 1000, 1, order[0], n - 1, n)


@pytest.mark.parametrize("n", [1, 2, 50, 3000])
def test_disjoint_sets_keep_offsets(n):
    r = random.Random(n)
    order = list(range(n))
    r.shuffle(order)
    parents = {i: (order[r.randrange(k)] if k and r.random() < 0.95 else None) for k, i in enumerate(order)}
    forest = Forest(list(range(n)), [parents[i] for i in range(n)])
    for node in range(n):
        at, depth = node, 0
        while parents[at] is not None:
            at, depth = parents[at], depth + 1
        assert forest.top[node] == at and forest.offset[node] == depth and forest.circle[node] == -1


def test_cycles_are_reported(spark):
    links = {1: 2, 2: 1, 3: 1, 4: None, 5: 5}
    f = frame(spark, links)
    assert {r.id for r in cycles(hierarchies(f), ancestor_pairs(f)).collect()} == {1, 2, 5}


@pytest.mark.parametrize("parts", [1, 4, 12])
def test_circles_are_told_from_what_hangs_on_them(spark, parts):
    links = {1: 2, 2: 1, 3: 1, 4: None, 5: 5, 6: 3, 7: 8, 8: 9, 9: 7, 10: 4}
    got = {(r.id, r.parent_id, r.circle, r.length) for r in circles(frame(spark, links), parts).collect()}
    assert got == {(1, 2, 1, 2), (2, 1, 1, 2), (5, 5, 5, 1), (7, 8, 7, 3), (8, 9, 7, 3), (9, 7, 7, 3)}


def test_descendants_and_circles_are_queries(spark, monkeypatch):
    monkeypatch.setattr(problems, "symbol_links", lambda *_: frame(spark, {1: None, 2: 1, 3: 2, 4: 5, 5: 4, 6: 4}))
    below = {(r.symbol_id, r.descendant_id, r.distance) for r in problems.queries()["p3_descendants"](spark, "").collect()}
    assert below == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (4, 5, 1), (4, 4, 2), (5, 4, 1), (5, 5, 2), (4, 6, 1), (5, 6, 2)}
    around = {(r.symbol_id, r.parent_id, r.cycle_id) for r in problems.queries()["p3_cycles"](spark, "").collect()}
    assert around == {(4, 5, 4), (5, 4, 4)}


NODES = "group string, id long, name string, parent string, children array<string>, parent_id string"


def test_names_become_links(spark):
    nodes = [
        ("f", 1, "A", None, ["b", " c "], "x"), ("f", 2, "b", "A", None, "x"), ("f", 3, "c", "  ", None, "x"), ("f", 4, "d", "mod.A", [], "x"), ("f", 5, "e", "pkg::b", None, "x"), ("f", 6, "g", "Gone", None, "x"),
        ("g", 7, "A", None, None, "x"), ("g", 8, "h", " A ", None, "x"), ("f", 2, "b", "A", None, "x"), ("f", 9, None, "A", [None, ""], "x"), ("f", 10, "k", "x/y#c", None, "x"), ("f", 11, "c2$", "$", None, "x"),
    ]
    got = {r.id: r.parent_id for r in name_links(spark.createDataFrame(nodes, NODES)).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: 1, 5: 2, 6: None, 7: None, 8: 7, 9: 1, 10: 3, 11: None}


def test_empty(spark):
    empty = spark.createDataFrame([], LINKS)
    assert ancestor_pairs(empty).count() == 0 and hierarchies(empty).count() == 0
    assert name_links(spark.createDataFrame([], NODES)).count() == 0
