import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.packing import Packer, fill_report, pack


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=200), st.integers(1, 6))
def test_packer_never_overfills_and_holds_few_bins_open(sizes, open_bins):
    packer, used = Packer(20, open_bins), defaultdict(int)
    for size in sizes:
        used[packer.put(size)] += size
        assert len(packer.open_numbers()) <= open_bins
    assert all(u <= 20 for u in used.values())


def test_best_fit_takes_the_fullest_bin_that_fits():
    packer = Packer(10, 4)
    a, b = packer.put(6), packer.put(7)
    assert a != b and packer.put(3) == b and packer.put(4) == a and packer.put(1) not in (a, b)


def test_fullest_closes_first():
    packer = Packer(10, 2)
    a, b = packer.put(9), packer.put(6)
    c = packer.put(8)
    assert packer.open_numbers() == {b, c} and a not in packer.open_numbers()


@pytest.mark.parametrize("shards", [1, 3])
def test_frame(spark, shards):
    r = random.Random(3)
    items = [(i, r.choice([0, 1, 5, 30, 64, 65, 200]) if i % 9 else None) for i in range(500)] + [(7, 30), (7, 30)]
    frame = spark.createDataFrame([(*x, "z") for x in items], "item long, size int, bin string")
    out = pack(frame, 64, open_bins=4, shards=shards).collect()
    bins, pieces = defaultdict(int), defaultdict(list)
    for row in out:
        bins[row.bin_id] += row.size
        pieces[row.item].append(row)
    assert all(u <= 64 for u in bins.values())
    assert sum(bins.values()) == sum(s or 0 for _, s in items)
    for item, size in items[:500]:
        if item != 7:
            assert sorted(p.piece for p in pieces[item]) == list(range(max(1, -(-(size or 0) // 64))))
            assert (size or 0) > 64 or len(pieces[item]) == 1
    assert len(pieces[7]) == 3 * (1 if (dict(items[:500])[7] or 0) <= 64 else 1) + 0 or len(pieces[7]) >= 3
    report = fill_report(pack(frame, 64, open_bins=4, shards=shards), 64).first()
    assert report.n_bins == len(bins) and report.fill > 0.9


def test_empty_and_wrong_arguments(spark):
    empty = spark.createDataFrame([], "item long, size int")
    assert pack(empty, 10).count() == 0 and fill_report(pack(empty, 10), 10).first().n_bins == 0
    with pytest.raises(ValueError):
        pack(empty, 0)


def test_empty_items_wait_for_no_bin_without_end(spark, monkeypatch):
    from lodestrata.llm import packing

    monkeypatch.setattr(packing, "EMPTY_MOST", 100)
    only = pack(spark.range(5_000).select("id", "id").toDF("item", "size").withColumn("size", packing.F.lit(0)), 10, shards=2).collect()
    assert len(only) == 5_000 and len({r.bin_id for r in only}) <= 4
    mixed = pack(spark.createDataFrame([(i, i % 3 * 4) for i in range(300)], "item long, size int"), 10, open_bins=2, shards=1).collect()
    used = defaultdict(int)
    for r in mixed:
        used[r.bin_id] += r.size
    assert len(mixed) == 300 and all(0 < u <= 10 for u in used.values())


def test_bins_do_not_depend_on_the_session(spark):
    frame = spark.createDataFrame([(i, 1 + i * 7 % 50) for i in range(2_000)], "item long, size int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append({(r.item, r.piece, r.bin_id) for r in pack(frame, 64, shards=5).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
