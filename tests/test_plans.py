"""Kernels against plain Python on random data with hot keys, copies and ties."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstream import plans
from loamstream.plans import reduce
from loamstream.session import cut_lineage

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def series(n, keys=("a", "a", "a", "b"), seed=1, step=7):
    rnd = random.Random(seed)
    return [(rnd.choice(keys), T0 + dt.timedelta(minutes=step * rnd.randrange(n * 2)), i, rnd.choice([None, 1.0, 2.0, 3.5, 9.0])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, id bigint, v double")


@pytest.mark.parametrize("lead", [False, True])
@pytest.mark.parametrize("width", [3600, 86400, None])
def test_lag_equals_sorted_list(spark, width, lead):
    rows = series(200)
    got = {r.id: r.p for r in plans.lag_in_time(frame(spark, rows), ["k"], ["ts", "id"], {"id": "p"}, width, lead=lead).collect()}
    want = {}
    for k in "ab":
        ids = [r[2] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))]
        ids = ids[::-1] if lead else ids
        want.update(dict(zip(ids, [None, *ids])))
    assert got == want


@pytest.mark.parametrize("width", [3600, None])
def test_running_total_and_last_known(spark, width):
    rows = series(150, seed=2)
    df = frame(spark, rows)
    total = {r.id: r.t for r in plans.running_total(df, ["k"], ["ts", "id"], F.lit(1).cast("bigint"), "t", width).collect()}
    last = {r.id: r.p for r in plans.last_known_before(df, ["k"], ["ts", "id"], "v", "p", 3600).collect()}
    for k in "ab":
        seen = None
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), 1):
            assert total[r[2]] == n
            assert last[r[2]] == seen
            seen = r[3] if r[3] is not None else seen


def test_true_runs(spark):
    rows = series(200, seed=3)
    runs = plans.true_runs(frame(spark, rows), ["k"], ["ts", "id"], F.col("v") > 1.5, 3600)
    got = sorted(tuple(sorted(r.ids)) for r in runs.groupBy("k", "run_id").agg(F.collect_list("id").alias("ids")).collect())
    want = []
    for k in "ab":
        cur = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            if r[3] is not None and r[3] > 1.5:
                cur.append(r[2])
            elif cur:
                want.append(tuple(sorted(cur)))
                cur = []
        if cur:
            want.append(tuple(sorted(cur)))
    assert got == sorted(want)


def test_interval_join_equals_naive(spark):
    rows = series(120, seed=4)
    rnd = random.Random(5)
    spans = [(rnd.choice("ab"), i, T0 + HOUR * rnd.randrange(30), T0 + HOUR * rnd.randrange(30)) for i in range(40)]
    iv = spark.createDataFrame(spans, "k string, sid int, s timestamp_ntz, e timestamp_ntz")
    for width in (1800, 6 * 3600):
        for closed in (True, False):
            got = sorted((r.sid, r.id) for r in plans.interval_join(frame(spark, rows), iv, ["k"], "ts", "s", "e", width, closed).collect())
            want = sorted((s[1], r[2]) for s in spans for r in rows if s[0] == r[0] and s[2] <= r[1] and (r[1] <= s[3] if closed else r[1] < s[3]))
            assert got == want


@pytest.mark.parametrize("tol", [None, 1800.0])
def test_nearest_and_latest(spark, tol):
    left, right = series(80, seed=6), series(60, seed=7)
    r = frame(spark, right).select("k", F.col("ts").alias("rts"), F.col("id").alias("rid"))
    near = {x.id: x.rid for x in plans.nearest_join(frame(spark, left), r, ["k"], "ts", "rts", ["rid"], tol, ["rid"], 3600).collect()}
    back = {x.id: x.rid for x in plans.latest_before(frame(spark, left), r, ["k"], "ts", "rts", ["rid"], ["rid"], 3600).collect()}
    for k, ts, i, _ in left:
        same = [x for x in right if x[0] == k]
        best = min(same, key=lambda x: (abs(x[1] - ts), x[1], x[2]))
        ok = tol is None or abs((best[1] - ts).total_seconds()) <= tol
        assert near[i] == (best[2] if ok else None)
        before = [x for x in same if x[1] <= ts]
        want = None
        if before:
            last = max(x[1] for x in before)
            want = min(x[2] for x in before if x[1] == last)
        assert back[i] == want


def _sorted(rows, k):
    return sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))


@pytest.mark.parametrize("width", [1800, 3600, 86400])
def test_lag_where_equals_a_filtered_lag(spark, width):
    rows = [(k if i % 11 else None, t, i, v) for k, t, i, v in series(260, seed=21, step=23)]
    keep = (F.col("p") != F.col("v")) | (F.col("v").isNull() & (F.col("q") % 3 == 0))
    got = sorted((r.id, r.q, r.p) for r in plans.lag_where(frame(spark, rows), ["k"], ["ts", "id"], {"v": "p", "id": "q"}, keep, width).collect())
    want = []
    for k in ("a", "b", None):
        own = _sorted(rows, k)
        want += [(r[2], p[2], p[3]) for p, r in zip(own, own[1:]) if (p[3] is not None and r[3] is not None and p[3] != r[3]) or (r[3] is None and p[2] % 3 == 0)]
    assert got == sorted(want) and len(got) > 40


@pytest.mark.parametrize("width", [1800, 7200, 86400])
def test_flag_runs_equal_a_loop(spark, width):
    rows = [(k, t, i, v or 0.5) for k, t, i, v in series(400, seed=22, step=19)]
    flags = {"high": F.col("v") > 1.5, "low": F.col("v") < 3.0, "all": F.col("v") > 0, "none": F.col("v") > 99}
    tests = {"high": lambda v: v > 1.5, "low": lambda v: v < 3.0, "all": lambda v: True, "none": lambda v: False}
    want = []
    for k in "ab":
        for kind, test in tests.items():
            run = []
            for r in [*_sorted(rows, k), None]:
                if r and test(r[3]):
                    run.append(r)
                elif run:
                    top = max(x[3] for x in run)
                    want.append((k, kind, run[0][1], run[-1][1], len(run), min(x[3] for x in run), top, next(x[1] for x in run if x[3] == top)))
                    run = []
    got = [tuple(r) for r in plans.flag_runs(frame(spark, rows), ["k"], ["ts", "id"], flags, "v", width).collect()]
    assert sorted(got) == sorted(want) and len(got) > 50


@pytest.mark.parametrize("width", [1800, 86400])
def test_gap_sessions_equal_a_loop(spark, width):
    rows = [(k, t, i, v or 0.5) for k, t, i, v in series(300, seed=23, step=31)]
    want = []
    for k in "ab":
        own = _sorted(rows, k)
        cuts = [0, *(i for i in range(1, len(own)) if own[i][1] - own[i - 1][1] > HOUR), len(own)]
        want += [(k, own[a][1], own[b - 1][1], own[a][2], own[b - 1][2], sum(r[3] for r in own[a:b])) for a, b in zip(cuts, cuts[1:])]
    out = plans.gap_sessions(frame(spark, rows), ["k"], ["ts", "id"], 3_600_000_000, {"id": "a"}, {"id": "b"}, {"v": "s"}, width)
    assert sorted((r.k, r.start, r.end, r.a, r.b, r.s) for r in out.collect()) == sorted(want) and len(want) > 20


def _largest_group(df, column):
    return df.groupBy(column).count().agg(F.max("count")).first()[0]


def test_nearest_without_a_key_spreads_a_hot_day(spark, monkeypatch):
    """A third of the rows on one day, the rest over decades; no task sees the whole line."""
    from loamstream.plans import ranges

    monkeypatch.setattr(ranges, "EVEN_ROWS", 16)
    rnd = random.Random(12)
    times = lambda n: [T0 + dt.timedelta(seconds=rnd.randrange(86400)) if rnd.random() < 0.4 else T0 + dt.timedelta(days=rnd.randrange(-18000, 9000), seconds=rnd.randrange(86400)) for _ in range(n)]
    left = [(t, i) for i, t in enumerate(times(900))] + [(None, 900)]
    right = [(t, i) for i, t in enumerate(times(300))] + [(T0 + dt.timedelta(days=5), 300), (T0 + dt.timedelta(days=5), 301), (None, 302)]
    l, r = spark.createDataFrame(left, "ts timestamp_ntz, id int"), spark.createDataFrame(right, "rts timestamp_ntz, rid int")
    out = plans.nearest_join(l, r, [], "ts", "rts", ["rid"], None, ["rid"])
    got = {x.id: x.rid for x in out.collect()}
    known = [x for x in right if x[0]]
    for t, i in left:
        assert got[i] == (min(known, key=lambda x: (abs(x[0] - t), x[0], x[1]))[1] if t else None)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    lines = ranges._evenly([l.withColumnRenamed("ts", "_t"), r.withColumnRenamed("rts", "_t")], 86400, 16)
    assert _largest_group(lines[0].filter("_t IS NOT NULL"), "_slice") < 60
    assert lines[0].filter("_t IS NOT NULL").orderBy("_t").agg(F.collect_list("_slice").alias("s")).select((F.col("s") == F.array_sort("s")).alias("ok")).first().ok


def test_nearest_at_exact_tolerance_and_tie(spark):
    left = spark.createDataFrame([("a", T0 + HOUR)], "k string, ts timestamp_ntz")
    right = spark.createDataFrame([("a", T0, 1), ("a", T0 + 2 * HOUR, 2)], "k string, rts timestamp_ntz, rid int")
    assert plans.nearest_join(left, right, ["k"], "ts", "rts", ["rid"], 3600.0).first().rid == 1
    assert plans.nearest_join(left, right, ["k"], "ts", "rts", ["rid"], 3599.0).first().rid is None


def test_exact_quantiles_equal_numpy(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["hot", "hot", "hot", None]), rnd.choice([rnd.uniform(-50, 50), 7.0, 7.25])) for _ in range(500)] + [("one", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p01": 0.01, "p50": 0.5, "p95": 0.95}
    for slices in (1, 4, 256):
        got = {r.k: (r.p01, r.p50, r.p95) for r in plans.exact_quantiles(df, ["k"], "v", probs, slices=slices).collect()}
        for k in ("hot", None, "one"):
            want = np.quantile([v for kk, v in rows if kk == k], list(probs.values()))
            assert np.allclose(got[k], want)


def test_value_slices_bound_a_key_inside_one_unit(spark):
    """All values of the hot key lie within a thousandth; weights sit on one value."""
    rnd = random.Random(13)
    rows = [("hot", 7.0 + rnd.random() / 1000, 1) for _ in range(20_000)] + [("hot", 7.0005, 30_000), ("wide", 1e9, 2), ("wide", -1e9, 1), (None, 5.0, 1)]
    df = spark.createDataFrame(rows, "k string, v double, n int")
    counted = df.groupBy("k", F.col("v").alias("_v")).agg(F.sum("n").alias("_n"))
    assert _largest_group(reduce._value_slices(counted, ["k"], 64).filter("k = 'hot'"), "_slice") < 2 * 20_000 / 64
    got = {r.k: (r.p10, r.p60) for r in plans.exact_quantiles(df, ["k"], "v", {"p10": 0.1, "p60": 0.6}, "n", 64).collect()}
    for k in ("hot", "wide", None):
        own = np.repeat(*(np.array(x) for x in zip(*((v, n) for kk, v, n in rows if kk == k), strict=True)))
        assert np.allclose(got[k], np.quantile(own, [0.1, 0.6]), rtol=1e-12)


def test_column_quantiles_keep_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None)], "k string, x double, y double")
    r = plans.column_quantiles(df, ["k"], ["x", "y"], {"q": 0.5}).first()
    assert (r.q_x, r.q_y) == (2.0, None)


def test_keep_latest_is_idempotent(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 1, "y"), ("a", 2, 3, None)], "k string, source_rank int, row_no int, v string")
    once = plans.keep_latest(df, ["k"], ["source_rank", "row_no"])
    assert [tuple(r) for r in once.collect()] == [("a", 2, 3, None)]
    assert plans.keep_latest(once, ["k"], ["source_rank", "row_no"]).collect() == once.collect()


def test_pair_values_without_partner(spark):
    df = spark.createDataFrame([(1, "S1", 5.0), (1, "S2", 2.0), (2, "S3", 1.0), (3, "X", 1.0)], "t int, strip string, value double")
    got = sorted((r.t, r.treated, r.control, r.treated_value, r.control_value) for r in plans.pair_values(df, ["t"], "strip", (("S1", "S2"), ("S3", "S4"))).collect())
    assert got == [(1, "S1", "S2", 5.0, 2.0), (2, "S3", "S4", 1.0, None)]


def test_cut_lineage_is_a_reliable_checkpoint(spark):
    out = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert out.count() == 10
    assert "Scan ExistingRDD" in out._jdf.queryExecution().executedPlan().toString()
