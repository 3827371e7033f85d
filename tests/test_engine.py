"""Queries over small series with answers worked out by hand."""

import math
import random

import pytest

from tideglass import Engine, MemorySeries, ParserOptions, QueryError

LOAD = """
jobs{team="red",node="n1",zone="east"} 3+7x10
jobs{team="red",node="n2",zone="east"} 5+4x10
jobs{team="red",node="n1",zone="west"} 0+2x10
jobs{team="blue",node="n1",zone="east"} 1+9x10
fall{pod="p"} 8 9 15 2 2 6 1
mixed{k="none"} NaN NaN NaN NaN NaN NaN
mixed{k="low"} 4 4 4 4 4 4
mixed{k="high"} 10 10 10 10 10 10
hole{a="x"} 7 1 stale 5
quota{team="red"} 200x10
size_bucket{le="1"} 0+3x10
size_bucket{le="4"} 0+9x10
size_bucket{le="+Inf"} 0+12x10
twin_a{z="1"} 1+1x10
twin_b{z="1"} 2+1x10
huge{i="1"} 9e307 9e307 9e307
huge{i="2"} 9e307 9e307 9e307
huge{i="3"} 9e307 9e307 9e307
"""


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, MemorySeries(LOAD, "1m"), options=ParserOptions.everything())


def rows(df):
    out = {}
    for r in df.collect():
        d = r.asDict()
        step, value = d.pop("step_ms"), d.pop("value")
        out[tuple(sorted((k, v) for k, v in d.items() if v)), step // 1000] = value
    return out


def at(engine, query, t=300):
    return {k[0]: v for k, v in rows(engine.instant_query(query, t)).items()}


def one(engine, query, t=300):
    got = at(engine, query, t)
    assert len(got) == 1, got
    return next(iter(got.values()))


@pytest.mark.parametrize(
    ("query", "value"),
    [
        ("1 + 2 * 3", 7.0), ("-2 ^ 2", -4.0), ("2 ^ 3 ^ 2", 512.0), ("1 / 0", math.inf), ("-7 % 3", -1.0), ("1 > bool 2", 0.0), ("time()", 300.0), ("pi()", math.pi),
        ("sum(jobs)", 119.0), ("count(jobs)", 4.0), ("avg(jobs)", 29.75), ("min(jobs)", 10.0), ("max(jobs)", 46.0), ("group(jobs)", 1.0),
        ("max(mixed)", 10.0), ("min(mixed)", 4.0), ("quantile(0.5, jobs)", 31.5), ("stddev(mixed{k!='none'})", 3.0), ("stdvar(mixed{k!='none'})", 9.0),
        ("scalar(quota)", 200.0), ("scalar(jobs)", math.nan), ("vector(3)", 3.0), ("absent(nothing{a='b'})", 1.0),
        ("sum(rate(jobs{team='blue'}[5m]))", 0.15), ("increase(jobs{team='blue'}[5m])", 45.0), ("irate(jobs{team='blue'}[5m])", 0.15), ("idelta(jobs{team='blue'}[5m])", 9.0),
        ("resets(fall[10m])", 1.0), ("changes(fall[10m])", 4.0), ("delta(jobs{team='blue'}[5m])", 45.0), ("sum_over_time(fall[3m])", 10.0), ("avg_over_time(fall[3m])", 10 / 3),
        ("count_over_time(fall[10m])", 6.0), ("max_over_time(fall[10m])", 15.0), ("min_over_time(fall[10m])", 2.0), ("last_over_time(fall[10m])", 6.0), ("first_over_time(fall[4m])", 15.0),
        ("present_over_time(fall[1m])", 1.0), ("stdvar_over_time(fall[2m])", 4.0), ("quantile_over_time(0.5, fall[3m])", 2.0), ("mad_over_time(fall[2m])", 2.0),
        ("deriv(jobs{team='blue'}[5m])", 0.15), ("predict_linear(jobs{team='blue'}[5m], 60)", 55.0), ("ts_of_max_over_time(fall[10m])", 120.0), ("ts_of_last_over_time(fall[10m])", 300.0),
        ("ts_of_first_over_time(fall[10m])", 0.0), ("ts_of_min_over_time(fall[10m])", 240.0), ("1 / ts_of_min_over_time(fall[2m] @ 60)", math.inf),
        ("sum_over_time(quota[3m:1m])", 600.0), ("max_over_time(sum(jobs)[5m:1m])", 119.0), ("sum(jobs offset 1m)", 97.0), ("sum(jobs @ 60)", 31.0), ("sum(jobs @ end())", 119.0), ("sum(jobs @ start() offset -1m)", 141.0),
        ("histogram_quantile(0.5, size_bucket)", 2.5), ("histogram_fraction(0, 1, size_bucket)", 0.25), ("round(vector(2.5))", 3.0), ("round(vector(7), 5)", 5.0), ("clamp(quota, 0, 10)", 10.0),
        ("clamp_min(quota, 300)", 300.0), ("ln(vector(0))", -math.inf), ("floor(vector(-1.5))", -2.0), ("ceil(vector(1.2))", 2.0), ("sgn(vector(-3))", -1.0), ("timestamp(quota)", 300.0),
        ("hour(vector(7200))", 2.0), ("day_of_week(vector(0))", 4.0), ("days_in_month(vector(0))", 31.0), ("year()", 1970.0), ("quota / on(team) sum by (team) (jobs{team='red'})", 200 / 73),
        # 400 Gregorian years are 146097 days: the same weekday and date, 400 years on, however far
        ("year(vector(12622780800 * 1000))", 401970.0), ("day_of_week(vector(12622780800 * 1000 + 86400))", 5.0), ("year(vector(-12622780800 * 3))", 770.0), ("day_of_month(vector(1e300))", math.nan),
        ("count(topk(2, jobs))", 2.0), ("sum(bottomk(1, jobs))", 10.0), ("count(limitk(3, jobs))", 3.0), ("count(limit_ratio(0.4, jobs) or limit_ratio(-0.6, jobs))", 4.0),
        ("increase(jobs{team='blue'}[5m] anchored)", 45.0), ("rate(jobs{team='blue'}[5m] smoothed)", 0.15), ("sum_over_time(fall[step()+3m])", 10.0),
        # sums beyond the doubles, means within
        ("avg(huge @ 0)", 9e307), ("sum(huge @ 0)", math.inf), ("avg_over_time(huge{i='1'}[5m] @ 120)", 9e307), ("avg(-huge @ 0)", -9e307), ("avg(huge @ 0 * -1 or vector(1) / 0)", math.inf),
        # level and trend 8, 1; after 9: 9, 1; 15: 12.5, 2.25; 2: 8.375, -0.9375; 2: 4.71875, -2.296875; 6: half of 6 and of 2.421875
        ("double_exponential_smoothing(fall[10m], 0.5, 0.5)", 4.2109375),
    ],
)
def test_one_value(engine, query, value):
    got = one(engine, query)
    assert math.isnan(got) if math.isnan(value) else got == pytest.approx(value, rel=1e-9)


def test_means_in_exact_mode(spark):
    s = MemorySeries(LOAD, "1m")
    assert one(Engine(spark, s, exact=True), "avg(huge @ 0)") == 9e307
    assert one(Engine(spark, s, exact=True), "avg_over_time(huge{i='1'}[5m] @ 120)") == 9e307


def test_labels_and_names(engine):
    assert at(engine, "quota") == {(("__name__", "quota"), ("team", "red")): 200.0}
    assert at(engine, "quota * 2") == {(("team", "red"),): 400.0}
    assert at(engine, "quota > 50") == {(("__name__", "quota"), ("team", "red")): 200.0}
    assert at(engine, "sum by (team) (jobs)") == {(("team", "red"),): 73.0, (("team", "blue"),): 46.0}
    assert at(engine, "sum without (node, zone) (jobs)") == {(("team", "red"),): 73.0, (("team", "blue"),): 46.0}
    assert at(engine, 'count_values("v", quota)') == {(("v", "200"),): 1.0}
    assert at(engine, 'label_replace(quota, "x", "$1-y", "team", "r(.*)")') == {(("__name__", "quota"), ("team", "red"), ("x", "ed-y")): 200.0}
    assert at(engine, 'label_join(quota, "x", "-", "team", "team")') == {(("__name__", "quota"), ("team", "red"), ("x", "red-red")): 200.0}
    assert at(engine, 'histogram_quantiles(size_bucket, "q", 0.5, 0.99999999)') == pytest.approx({(("q", "0.5"),): 2.5, (("q", "0.99999999"),): 4.0})


def test_matching(engine):
    got = at(engine, "jobs / on(team) group_left quota")
    assert len(got) == 3 and got[(("node", "n1"), ("team", "red"), ("zone", "west"))] == 0.05
    assert at(engine, "quota / on(team) group_right jobs{zone='west'}") == {(("node", "n1"), ("team", "red"), ("zone", "west")): 20.0}
    assert at(engine, "jobs{zone='west'} / ignoring(node, zone) quota") == {(("team", "red"),): 0.05}
    assert len(at(engine, "jobs and on(team) quota")) == 3
    assert len(at(engine, "jobs unless on(team) quota")) == 1
    assert len(at(engine, "jobs or quota")) == 5
    assert at(engine, "sum by (team) (jobs) + on(team) fill_right(0) quota") == {(("team", "red"),): 273.0, (("team", "blue"),): 46.0}
    with pytest.raises(Exception, match="must be explicit"):
        at(engine, "jobs / on(team) quota")
    with pytest.raises(Exception, match="same labelset"):
        at(engine, 'rate({__name__=~"twin_a|twin_b"}[5m])')


def test_staleness_and_lookback(engine):
    got = rows(engine.range_query("hole", 0, 600, 60))
    assert [k[1] for k in sorted(got, key=lambda k: k[1])] == [0, 60, 180, 240, 300, 360, 420]
    assert rows(engine.range_query("hole @ 60", 0, 120, 60)) == {((("__name__", "hole"), ("a", "x")), t): 1.0 for t in (0, 60, 120)}


def test_staleness_markers_in_tables(spark, tmp_path):
    """A NaN with the marker's bits ends a series; another NaN is a sample."""
    import struct

    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from tideglass.sources.series import STALE_BITS, TableSeries

    marker = struct.unpack(">d", int(STALE_BITS, 16).to_bytes(8, "big"))[0]
    pq.write_table(pa.table({"t": [0, 60_000, 0, 60_000], "s": ["a", "a", "b", "b"], "v": [1.0, marker, 1.0, math.nan]}), f"{tmp_path}/t.parquet")
    table = spark.read.parquet(f"{tmp_path}/t.parquet")
    e = Engine(spark, TableSeries("m", table, F.col("t"), F.col("v"), {"s": F.col("s")}, markers=True))
    got = at(e, "m", 90)
    assert list(got) == [(("__name__", "m"), ("s", "b"))] and math.isnan(got[(("__name__", "m"), ("s", "b"))])
    assert len(at(e, "m", 30)) == 2 and len(at(e, "count_over_time(m[2m])", 60)) == 2
    assert at(e, 'count_over_time(m{s="a"}[2m])', 60) == {(("s", "a"),): 1.0}


def test_worked_rates(spark):
    """A counter that falls from 9 to 2; gaps of 20 s, so an edge 22 s away or more would count as 10 s."""
    s = MemorySeries().add({"__name__": "x"}, [(100_000, 4.0), (120_000, 9.0), (140_000, 2.0), (160_000, 6.0)])
    got = rows(Engine(spark, s).range_query("rate(x[1m])", 140, 180, 20))
    want = [
        7 * (40 + 20 + 0) / 40 / 60,  # (80, 140]: 4 9 2, change 5 + 2; at 7 in 40 s it was 0 some 23 s before, so 20 s it is
        6 * (40 + 20 + 0) / 40 / 60,  # (100, 160]: 9 2 6, change 2 + 4
        4 * (20 + 10 + 20) / 20 / 60,  # (120, 180]: 2 6, change 4; 10 s before it was 0
    ]
    assert [v for _, v in sorted(got.items(), key=lambda i: i[0][1])] == pytest.approx(want, abs=1e-12)


def brute_windows(samples, step, width):
    return [(t, v) for t, v in samples if step - width < t <= step]


@pytest.mark.parametrize("name", ["rate", "increase", "delta", "irate", "idelta", "changes", "resets"])
@pytest.mark.parametrize(("width", "step"), [(60, 7), (300, 11), (20, 60)])
def test_pairs_across_cells(spark, name, width, step):
    """Functions of neighbours against plain loops over each window, dense and sparse grids."""
    rng = random.Random(width + step)
    series = {}
    for k in "ab":
        times = sorted(rng.sample(range(0, 900_000, 500), 90))
        series[k] = [(t, float(rng.choice([0, 1, 2, 3, 5, math.nan]))) for t in times]
    s = MemorySeries()
    for k, samples in series.items():
        s.add({"__name__": "x", "k": k}, samples)
    got = rows(Engine(spark, s).range_query(f"{name}(x[{width}s])", 0, 900, step))

    def value(w, at):
        def lost(a, b):
            return a if b < a else 0.0

        if name in ("changes", "resets"):
            hit = (lambda a, b: a != b and not (math.isnan(a) and math.isnan(b))) if name == "changes" else (lambda a, b: b < a)
            return float(sum(hit(a, b) for (_, a), (_, b) in zip(w, w[1:], strict=False))) if w else None
        if len(w) < 2:
            return None
        if name in ("irate", "idelta"):
            (t0, a), (t1, b) = w[-2:]
            change = b - a
            return change if name == "idelta" else (b if b < a else change) / ((t1 - t0) / 1000)
        change = w[-1][1] - w[0][1] + (sum(lost(a, b) for (_, a), (_, b) in zip(w, w[1:], strict=False)) if name != "delta" else 0.0)
        span, near, far = (w[-1][0] - w[0][0]) / 1000, w[0][0] / 1000 - (at - width), at - w[-1][0] / 1000
        gap = span / (len(w) - 1)
        near, far = (gap / 2 if near >= 1.1 * gap else near), (gap / 2 if far >= 1.1 * gap else far)
        if name != "delta" and change > 0 and w[0][1] >= 0:
            near = min(near, span * w[0][1] / change)
        return change * (span + near + far) / span / (width if name == "rate" else 1)

    want = {}
    for k, samples in series.items():
        for at in range(0, 901, step):
            if (v := value(brute_windows(samples, at * 1000, width * 1000), at)) is not None:
                want[(("k", k),), at] = v
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (math.isnan(got[k]) and math.isnan(v)) or got[k] == pytest.approx(v, rel=1e-9, abs=1e-12), k


def test_double_exponential_smoothing(spark):
    """Against the plain recursion over each window."""
    rng = random.Random(2)
    samples = [(i * 15_000, rng.uniform(0, 100)) for i in range(40)]
    got = rows(Engine(spark, MemorySeries().add({"__name__": "x"}, samples), options=ParserOptions.everything()).range_query("double_exponential_smoothing(x[2m], 0.3, 0.7)", 0, 600, 30))
    want = {}
    for at_ in range(0, 601, 30):
        w = [v for _, v in brute_windows(samples, at_ * 1000, 120_000)]
        if len(w) > 1:
            level, trend = w[0], w[1] - w[0]
            for v in w[1:]:
                new = 0.3 * v + 0.7 * (level + trend)
                level, trend = new, 0.7 * (new - level) + 0.3 * trend
            want[(), at_] = level
    assert got == pytest.approx(want)


def test_filters_reach_the_scan(spark, tmp_path):
    """The time range and the labels of a query are filters of the files that it reads."""
    import datetime

    from tideglass.sources.tables import catalog

    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)
    spark.createDataFrame([(i, day(i), i % 3, "click", 1.5, "") for i in range(20)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, day(i), 2.0, "1-URGENT", "O") for i in range(20)], "o_orderkey long, o_orderdate timestamp, o_totalprice double, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, day(i), 2.0, "R", "O") for i in range(20)], "l_orderkey long, l_shipdate timestamp, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    e = Engine(spark, catalog(spark, str(tmp_path)), "6h", ParserOptions.everything())
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    for query, column, labels in (("events_value{event_type=\"click\"}", "ts", "event_type"), ("rate(events_total[6h])", "ts", None), ("sum(order_totalprice)", "o_orderdate", None), ("sum(ship_quantity{flag=\"R\"})", "l_shipdate", "l_returnflag"), ("value_bucket", "ts", None)):
        df = e.range_query(query, 1_704_500_000, 1_704_600_000, 3600)
        plan = df._jdf.queryExecution().executedPlan().toString()
        pushed = " ".join(x for x in plan.split("\n") if "PushedFilters" in x)
        assert f"LessThanOrEqual({column}," in pushed and (labels is None or f"EqualTo({labels}," in pushed), pushed
        assert query.startswith("rate(events_total") or f"GreaterThanOrEqual({column}," in pushed
        assert "props" not in pushed.split("ReadSchema")[-1]


def test_kahan(spark):
    s = MemorySeries('b{i="1"} 1e100\nb{i="2"} 1\nb{i="3"} -1e100', "1m")
    assert one(Engine(spark, s, exact=True), "sum(b)", 0) in (0.0, 1.0)
    s = MemorySeries("c 1e100 1 -1e100", "1m")
    assert one(Engine(spark, s, exact=True), "sum_over_time(c[5m])", 120) == 1.0


def test_kinds(engine):
    assert engine.instant_query('"text"', 0) == "text"
    assert {(r.ts_ms, r.value) for r in engine.instant_query("fall[2m]", 300).collect()} == {(240_000, 2.0), (300_000, 6.0)}
    with pytest.raises(QueryError, match="must be Scalar or instant Vector"):
        engine.range_query("quota[5m]", 0, 60, 60)
    assert [r.value for r in engine.instant_query("sort(jobs)", 300).collect()] == [10.0, 25.0, 38.0, 46.0]
    assert [r.value for r in engine.instant_query("sort_desc(jobs)", 300).collect()] == [46.0, 38.0, 25.0, 10.0]
    assert [r.node for r in engine.instant_query('sort_by_label(jobs, "node")', 300).collect()] == ["n1", "n1", "n1", "n2"]
    assert [r.node for r in engine.instant_query('sort_by_label_desc(jobs, "node")', 300).collect()] == ["n2", "n1", "n1", "n1"]


def test_histogram_only_syntax(engine):
    """Parsed, and refused by name: there are no native histograms."""
    from tideglass.errors import UnsupportedError

    for query in ("jobs </ 3", "jobs >/ on(team) quota", "jobs{__ignore_histogram_buckets__}"):
        with pytest.raises(UnsupportedError):
            engine.instant_query(query, 300)


@pytest.mark.parametrize("query", ["", "sum(", "x{", "1 > 2", "x[5m", "rate(x)", "foo(x)", "x and 1", '{a=""}', "x[0s]", "abs(x, 1)", "x + bool 1", "x offset", "sum(x) by", "topk(x)", "1 </ 2", "x </", "x{y}"])
def test_wrong_queries(engine, query):
    with pytest.raises(QueryError):
        engine.range_query(query, 0, 60, 60)


def test_gates(spark):
    e = Engine(spark, MemorySeries())
    for q in ("first_over_time(x[1m])", "a + fill(0) b", "rate(x[5m] anchored)", "x[5m+1m]", "limitk(1, x)"):
        with pytest.raises(QueryError, match="not enabled|experimental"):
            e.instant_query(q, 0)


@pytest.mark.parametrize("parts", [1, 7])
def test_layout_does_not_matter(spark, engine, parts):
    from tideglass import FrameSeries
    from tideglass.sources.series import Hints

    raw = MemorySeries(LOAD, "1m").select(spark, [], Hints(0, 10**9))
    other = Engine(spark, FrameSeries(raw.df.repartition(parts)), options=ParserOptions.everything())
    for q in ("sum by (team) (rate(jobs[3m]))", "hole", "max_over_time(fall[4m])"):
        assert rows(other.range_query(q, 0, 600, 60)) == pytest.approx(rows(engine.range_query(q, 0, 600, 60)))


def test_sizes_deal_the_series(spark, tmp_path, monkeypatch):
    """A table's series go to parts by the size of its files, so a task's memory does not grow with them."""
    from tideglass.operators import select
    from tideglass.queries import queries

    where = "/root/testdata/sf0.001"
    for size, parts in ((1 << 12, 8), (1 << 10, 26)):
        monkeypatch.setattr(select, "PART_BYTES", size)
        for name in ("increase", "rate", "irate", "sum_over_time", "mad_over_time", "double_exponential_smoothing", "smoothed", "instant_selector"):
            plan = queries()[name](spark, where)._jdf.queryExecution().executedPlan().toString()
            assert f", {parts}), REPARTITION_BY_NUM" in plan, (name, plan)


@pytest.mark.parametrize("name", ["rate", "increase", "delta", "changes", "resets"])
@pytest.mark.parametrize("mode", ["anchored", "smoothed"])
def test_extended_windows(spark, name, mode):
    """Against the definition, on series with ties, gaps, falls and samples at edges; the state of a window holds no list."""
    if mode == "smoothed" and name in ("changes", "resets"):
        pytest.skip("not of smoothed windows")
    draw = random.Random(7)
    lookback, step, width, last = 90_000, 30_000, 70_000, 900_000
    series = {f"s{i}": {t * 10_000 + draw.choice([0, 0, 3]): float(draw.randint(0, 9)) for t in draw.sample(range(90), n)} for i, n in enumerate([0, 1, 2, 5, 20, 80])}
    source = MemorySeries()
    for s, samples in series.items():
        source.add({"__name__": "m", "s": s}, sorted(samples.items()))
    engine = Engine(spark, source, lookback / 1000, ParserOptions.everything())
    df = engine.range_query(f"{name}(m[{width // 1000}s] {mode})", 0, last / 1000, step / 1000)
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.s, r.step_ms): r.value for r in df.collect()}
    counter, after = name in ("rate", "increase"), lookback if mode == "smoothed" else 0
    want = {}
    for s, samples in series.items():
        for end in range(0, last + 1, step):
            start = end - width
            seen = sorted((t, v) for t, v in samples.items() if start - lookback < t <= end + after)
            inside = [v for t, v in seen if start < t <= end]

            def edge(at, seen=seen, start=start):
                low, high = [x for x in seen if x[0] <= at][-1:], [x for x in seen if x[0] >= at][:1]
                if mode == "anchored":
                    return low[0][1] if low else next(v for t, v in seen if t > start)
                if not low or not high or low == high:
                    return (low or high)[0][1]
                (t0, v0), (t1, v1) = low[0], high[0]
                base = 0.0 if v1 < v0 and counter else v0
                return base + (v1 - base) * (at - t0) / (t1 - t0)

            if not seen or (mode == "anchored" and not inside):
                continue
            path = [edge(start), *inside, edge(end)]
            add = {"changes": lambda a, v: float(v != a), "resets": lambda a, v: float(v < a), "delta": lambda a, v: v - a}.get(name, lambda a, v: v if v < a else v - a)
            want[s, end] = sum(add(a, v) for a, v in zip(path, path[1:])) / (width / 1000 if name == "rate" else 1)
    assert got.keys() == want.keys()
    assert got == pytest.approx(want)


@pytest.mark.parametrize(("width", "step"), [(60, 7), (300, 11), (20, 60)])
def test_lists_of_spans(spark, width, step):
    """Medians and smoothing against plain loops, on dense and sparse series; lists are made once for all steps that see the same samples."""
    rng = random.Random(width * step)
    series = {k: sorted((t, float(rng.choice([0, 1, 2, 5, math.nan]))) for t in rng.sample(range(0, 900_000, 500), n)) for k, n in (("a", 90), ("b", 4))}
    s = MemorySeries()
    for k, samples in series.items():
        s.add({"__name__": "x", "k": k}, samples)
    engine = Engine(spark, s, options=ParserOptions.everything())

    def median(vs):
        vs = sorted(vs, key=lambda v: (not math.isnan(v), v))
        return vs[len(vs) // 2] if len(vs) % 2 else vs[len(vs) // 2 - 1] * 0.5 + vs[len(vs) // 2] * 0.5

    def holt(vs):
        level, trend = vs[0], vs[1] - vs[0]
        for v in vs[1:]:
            new = 0.3 * v + 0.7 * (level + trend)
            level, trend = new, 0.7 * (new - level) + 0.3 * trend
        return level

    for query, least, value in (("quantile_over_time(0.5, {})", 1, median), ("mad_over_time({})", 1, lambda vs: median([abs(v - median(vs)) for v in vs])), ("double_exponential_smoothing({}, 0.3, 0.7)", 2, holt)):
        df = engine.range_query(query.format(f"x[{width}s]"), 0, 900, step)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("explode(sequence") < plan.index("collect_list"), plan
        got = rows(df)
        want = {((("k", k),), at): value(vs) for k, samples in series.items() for at in range(0, 901, step) if len(vs := [v for _, v in brute_windows(samples, at * 1000, width * 1000)]) >= least}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert (math.isnan(got[k]) and math.isnan(v)) or got[k] == pytest.approx(v, abs=1e-12), (query, k)


def test_last_two_samples_are_not_sorted(spark):
    plan = Engine(spark, MemorySeries("x 1+1x10")).range_query("irate(x[5m])", 0, 600, 60)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def duckdb_rows(name: str, where: str) -> list[tuple]:
    import duckdb

    from tideglass.queries import oracle_sql

    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS FROM '{where}/events.parquet'")
    return sorted(con.execute(oracle_sql()[name]).fetchall())


def test_resets_in_parts(spark, monkeypatch):
    """A part of the series for each PART_BYTES of the table, one row for a span and not for each step before the last, and the same answer."""
    from tideglass.operators import select
    from tideglass.queries import queries

    where = "/root/testdata/sf0.001"
    monkeypatch.setattr(select, "PART_BYTES", 1 << 10)
    df = queries()["resets"](spark, where)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert ", 26), REPARTITION_BY_NUM" in plan, plan
    assert plan.index("sequence(") < plan.index("HashAggregate"), plan  # of the tree, the top is first: steps come last
    assert sorted(tuple(r) for r in df.collect()) == duckdb_rows("resets", where)


def joined_in_parts(spark, name, where="/root/testdata/sf0.001"):
    """Both sides of a query's join go to 26 parts by match key and step, and no window looks for equal labels after it."""
    from tideglass.queries import queries

    df = queries()[name](spark, where)
    plan = df._jdf.queryExecution().executedPlan().toString()
    parts = [x for x in plan.split("\n") if ", 26), REPARTITION_BY_NUM" in x]
    assert sum("key_event_type" in x and "key_step" in x for x in parts) == 2, plan
    assert "raise_error" not in plan, plan
    assert sorted(tuple(r) for r in df.collect()) == duckdb_rows(name, where)


def test_group_left_in_parts(spark, monkeypatch):
    from tideglass.operators import select

    monkeypatch.setattr(select, "PART_BYTES", 1 << 10)
    joined_in_parts(spark, "group_left")


def test_group_right_in_parts(spark, monkeypatch):
    from tideglass.operators import select

    monkeypatch.setattr(select, "PART_BYTES", 1 << 10)
    joined_in_parts(spark, "group_right")


def test_equal_labels_in_parts(spark, monkeypatch):
    """Where two series may become one, the search for equal labels goes to parts by size, too."""
    from tideglass.operators import select
    from tideglass.sources.tables import catalog

    monkeypatch.setattr(select, "PART_BYTES", 1 << 10)
    e = Engine(spark, catalog(spark, "/root/testdata/sf0.001"), "6h", ParserOptions.everything())
    query = 'sum by (event_type, user_id) (events_value) * on(event_type) group_left({}) label_replace(sum by (event_type) (events_value), "{}", "$1", "event_type", "(.).*")'
    plan = e.range_query(query.format("user_id", "user_id"), 1_704_067_200, 1_704_153_600, 3600)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "raise_error" in above and ", 26), REPARTITION_BY_NUM" in above, plan


@pytest.mark.parametrize("query", ["m * on(g) group_left(x) o", '{__name__=~"m|n"} * on(g) group_left o', "o * on(g) group_right(x) m", "m * on(g) group_left(x) fill_left(1) o", 'o - on(g) group_right {__name__=~"m|n"}'])
def test_many_sides_that_become_equal(spark, query):
    """A label from the one side, or a name that goes, may make two series equal."""
    e = Engine(spark, MemorySeries('m{g="1",x="a"} 1\nm{g="1",x="b"} 2\nn{g="1",x="a"} 3\no{g="1",x="z"} 4'), options=ParserOptions.everything())
    with pytest.raises(Exception, match="same labelset"):
        e.instant_query(query, 0).collect()


@pytest.mark.parametrize(("query", "want"), [("m * on(g) group_left o", {"a": 4.0, "b": 8.0}), ("o - on(g) group_right m", {"a": 3.0, "b": 2.0}), ("m < on(g) group_left o", {"a": 1.0, "b": 2.0})])
def test_many_sides_that_stay_apart(spark, query, want):
    e = Engine(spark, MemorySeries('m{g="1",x="a"} 1\nm{g="1",x="b"} 2\no{g="1"} 4'), options=ParserOptions.everything())
    df = e.instant_query(query, 0)
    assert {r.x: r.value for r in df.collect()} == want
    assert "raise_error" not in df._jdf.queryExecution().optimizedPlan().toString()


def parts_by_rows(spark, where, monkeypatch, name):
    """A part for each PART_BYTES at 20 bytes a row, though the files take far fewer, and the same answer."""
    import duckdb

    from tideglass.operators import select
    from tideglass.queries import queries

    rows = "SELECT i AS event_id, TIMESTAMP '2024-01-02' + to_minutes(i) AS ts, i % 4 AS user_id, CASE WHEN i % 3 = 0 THEN 'click' ELSE 'view' END AS event_type, (i * i % 7)::DOUBLE AS value FROM range(5000) r(i)"
    duckdb.connect().execute(f"COPY ({rows}) TO '{where}/events.parquet' (FORMAT parquet, COMPRESSION zstd, PARQUET_VERSION V2)")
    assert (where / "events.parquet").stat().st_size < 20_000
    for other in ("orders", "lineitem"):
        (where / f"{other}.parquet").symlink_to(f"/root/testdata/sf0.001/{other}.parquet")
    monkeypatch.setattr(select, "PART_BYTES", 1 << 12)
    df = queries()[name](spark, str(where))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert ", 24), REPARTITION_BY_NUM" in plan, plan
    assert sorted(tuple(r) for r in df.collect()) == duckdb_rows(name, where)


def test_resets_in_parts_by_rows(spark, tmp_path, monkeypatch):
    parts_by_rows(spark, tmp_path, monkeypatch, "resets")


def test_rows_of_many_files(spark, tmp_path):
    """Of many files some footers are read, and the others count like them."""
    from tideglass.sources import tables

    def size(rows, files):
        where = str(tmp_path / f"{rows}_{files}")
        spark.range(rows).selectExpr("1L AS x").repartition(files).write.parquet(where)
        return tables._size(spark.read.parquet(where))

    assert size(0, 1) < 20_000
    assert size(30_000, 3) == pytest.approx(600_000, rel=0.01)
    assert size(200_000, 20) == pytest.approx(4_000_000, rel=0.05)


def test_group_right_in_parts_by_rows(spark, tmp_path, monkeypatch):
    parts_by_rows(spark, tmp_path, monkeypatch, "group_right")
