from datetime import datetime, timedelta

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestrata.functions.paths import normalize_path
from lodestrata.operators.orphans import orphan_references, orphan_report

REFS = "table_name string, record_id string, kind string, key string, at timestamp_ntz, reason string"
PARENTS = "kind string, key string, at timestamp_ntz, seq long, alive boolean"
T0 = datetime(2024, 1, 1)


def frames(spark, refs, parents):
    # 'reason' is an extra column whose name the result has too.
    return spark.createDataFrame([(*r, "x") for r in refs], REFS), spark.createDataFrame(parents, PARENTS)


def brute(refs, parents):
    out = set()
    for table, record, kind, key, at in set(refs):
        if key is None:
            continue
        known = [p for p in parents if p[0] == kind and p[1] == key and p[2] is not None]
        before = [p for p in known if at is not None and p[2] <= at]
        if before and max(before, key=lambda p: (p[2], p[3]))[4]:
            continue
        alive = [p[2] for p in known if p[4]]
        reason = "missing" if not alive else "deleted" if at is not None and min(alive) <= at else "late"
        out.add((table, record, kind, key, at, reason))
    return out


def result(spark, refs, parents):
    return {tuple(r) for r in orphan_references(*frames(spark, refs, parents)).select("table_name", "record_id", "kind", "target", "at", "reason").collect()}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_equals_brute_force(spark, data):
    time = st.one_of(st.none(), st.integers(0, 6).map(lambda d: T0 + timedelta(days=d)))
    key = st.sampled_from(["a", "b", "c", "ü", None])
    refs = data.draw(st.lists(st.tuples(st.just("t"), st.sampled_from("123"), st.just("file"), key, time), max_size=12))
    parents = data.draw(st.lists(st.tuples(st.just("file"), key, time, st.integers(0, 3), st.booleans()), max_size=12, unique_by=lambda p: (p[1], p[2], p[3])))
    assert result(spark, refs, parents) == brute(refs, parents)


def test_hot_key_spread_over_tasks(spark):
    refs = [("t", str(i), "s", "hot", T0 + timedelta(hours=i)) for i in range(400)]
    parents = [("s", "hot", T0 + timedelta(hours=100), 0, True), ("s", "hot", T0 + timedelta(hours=250), 1, False)]
    assert result(spark, refs, parents) == brute(refs, parents)


def test_empty_tables_and_report(spark):
    assert result(spark, [], []) == set()
    refs = [("t", "1", "s", "a", T0), ("t", "2", "s", "a", None), ("t", "1", "s", "a", T0)]
    assert {r[5] for r in result(spark, refs, [])} == {"missing"}
    report = orphan_report(orphan_references(*frames(spark, refs, []))).toPandas()
    assert report.set_index("month", drop=False).loc["2024-01", "n_references"] == 1 and report.month.isna().sum() == 1


def test_paths_are_resolved(spark):
    cases = {" a\\b//c ": "a/b/c", "./a/./b": "a/b", "a/../b": "b", "../a": "a", "a/b/../../c": "c", " ": "", "A/b": "A/b"}
    frame = spark.createDataFrame(pd.DataFrame({"p": list(cases)}))
    assert [r[0] for r in frame.select(normalize_path(frame.p)).collect()] == list(cases.values())
