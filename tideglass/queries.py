"""Queries over the synthetic tables and the same answers in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .plans.parser import ParserOptions
from .sources.tables import catalog

#: 2024-01-01 to 2024-01-31, hourly: all of events; seconds.  Windows of six hours hold every event.
START, END, STEP = 1_704_067_200, 1_706_659_200, 3600
LOOKBACK = "6h"
EVENTS = "SELECT event_type, user_id::VARCHAR AS user_id, epoch_us(ts) // 1000 AS ts_ms, value FROM events"
TOTAL = "SELECT event_type, user_id::VARCHAR AS user_id, epoch_us(ts) // 1000 AS ts_ms, (row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id))::DOUBLE AS value FROM events"
GRID = f"SELECT unnest(range({START}000, {END}000 + 1, {STEP}000)) AS step_ms"
W = 6 * 3_600_000


def _sql(select: str, **ctes: str) -> str:
    parts = {"grid": GRID, **({"s0": ctes["s0"]} if "s0" in ctes else {}), "s": EVENTS, **ctes}
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in parts.items()) + " " + select


def _windows(labels: str = "event_type, user_id", extra: str = "", width: int = W, offset: int = 0) -> str:
    """Samples with the steps whose windows hold them."""
    return f"SELECT g.step_ms, {labels}, s.ts_ms, s.value, g.step_ms - {offset + width} AS ws{extra} FROM grid g JOIN s ON s.ts_ms > g.step_ms - {offset + width} AND s.ts_ms <= g.step_ms - {offset}"


#: Samples with what came before them in their series.
PAIRED = "SELECT *, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts_ms) AS pv, lag(ts_ms) OVER (PARTITION BY event_type, user_id ORDER BY ts_ms) AS pt FROM s0"


def _over(agg: str, having: str = "", source: str = EVENTS) -> str:
    return _sql(f"SELECT event_type, user_id, step_ms, round(({agg})::DOUBLE, 6) AS value FROM w GROUP BY ALL {having}", s=source, w=_windows())


def _pairs(agg: str, having: str = "", source: str = EVENTS) -> str:
    return _sql(f"SELECT event_type, user_id, step_ms, round(({agg})::DOUBLE, 6) AS value FROM w GROUP BY event_type, user_id, step_ms {having}", s0=source, s=PAIRED, w=_windows(extra=", s.pv, s.pt"))


def _rate(counter: bool, per_second: bool, source: str = EVENTS, digits: int = 6) -> str:
    lost = "sum(CASE WHEN pt > ws AND value < pv THEN pv ELSE 0 END)" if counter else "0"
    near = "least(near0, CASE WHEN change > 0 AND v0 >= 0 THEN span * (v0 / change) ELSE near0 END)" if counter else "near0"
    select = f"""
        , a AS (SELECT event_type, user_id, step_ms, min(ws) AS ws, count(*) AS n, min(ts_ms) AS t0, max(ts_ms) AS tn, arg_max(value, ts_ms) - arg_min(value, ts_ms) + {lost} AS change, arg_min(value, ts_ms) AS v0 FROM w GROUP BY event_type, user_id, step_ms HAVING count(*) > 1),
        b AS (SELECT *, (t0 - ws) / 1000.0::DOUBLE AS ds, (ws + {W} - tn) / 1000.0::DOUBLE AS de, (tn - t0) / 1000.0::DOUBLE AS span, (tn - t0) / 1000.0::DOUBLE / (n - 1) AS gap FROM a),
        c AS (SELECT *, CASE WHEN ds >= 1.1 * gap THEN gap / 2 ELSE ds END AS near0, CASE WHEN de >= 1.1 * gap THEN gap / 2 ELSE de END AS far FROM b)
        SELECT event_type, user_id, step_ms, round(change * ((span + {near} + far) / span){f" / {W / 1000}" if per_second else ""}, {digits}) AS value FROM c"""
    return _sql(select.strip(), s0=source, s=PAIRED, w=_windows(extra=", s.pv, s.pt")).replace(") , a AS", "), a AS")


def _edge(k: str) -> str:
    """The value at an edge, between the samples before and after it."""
    return f"CASE WHEN {k}v0 IS NULL THEN {k}v1 WHEN {k}v1 IS NULL OR {k}t0 = {k}t1 THEN {k}v0 ELSE {k}v0 + ({k}v1 - {k}v0) * (({k} - {k}t0)::DOUBLE / ({k}t1 - {k}t0)) END"


#: The instant selector: latest sample in the six hours up to a step.
LATEST = f"""SELECT * FROM (SELECT q.event_type, q.user_id, q.step_ms, s.ts_ms, s.value FROM (SELECT * FROM grid, (SELECT DISTINCT event_type, user_id FROM s)) q
    ASOF JOIN s ON q.event_type = s.event_type AND q.user_id = s.user_id AND q.step_ms >= s.ts_ms) WHERE ts_ms > step_ms - {W}"""
#: Five series: values of each type in the last six hours.
SUMS = "SELECT event_type, step_ms, sum(value) AS value FROM w GROUP BY ALL"
SUMS_QUERY = "sum by (event_type) (sum_over_time(events_value[6h]))"


def _latest(select: str, where: str = "true") -> str:
    return _sql(select, s=f"{EVENTS} WHERE {where}", v=LATEST)


def _sums(select: str, **more: str) -> str:
    return _sql(select, w=_windows(), v=SUMS, **more)


def _each(expr: str, keep: str = "true") -> str:
    return _sums(f"SELECT event_type, step_ms, round(({expr})::DOUBLE, 6) AS value FROM v WHERE {keep}")


NAMED = "SELECT 'events_value' AS __name__, event_type, user_id, step_ms, round(value, 6) AS value FROM v"
BUCKETS = "SELECT event_type, (epoch_us(ts) // 3600000000) * 3600000 AS h, count(*) FILTER (value <= 10) AS b10, count(*) FILTER (value <= 50) AS b50, count(*) FILTER (value <= 100) AS b100, count(*) FILTER (value <= 200) AS b200, count(*) AS n FROM events GROUP BY ALL"

#: name: (query, SQL or None).
QUERIES: dict[str, tuple[str, str | None]] = {
    "sum_by_sum_over_time": (SUMS_QUERY, _each("value")),
    # selectors
    "instant_selector": ("events_value", _latest(NAMED)),
    "matcher_equal": ('events_value{event_type="click"}', _latest(NAMED, "event_type = 'click'")),
    "matcher_not_equal": ('events_value{event_type!="click",nothing=""}', _latest(NAMED, "event_type <> 'click'")),
    "matcher_regex": ('events_value{event_type=~"c.*|v.*"}', _latest(NAMED, "regexp_full_match(event_type, 'c.*|v.*')")),
    "matcher_not_regex": ('events_value{event_type!~"c.*|v.*"}', _latest(NAMED, "NOT regexp_full_match(event_type, 'c.*|v.*')")),
    "timestamp_of_sample": ("timestamp(events_value)", _latest("SELECT event_type, user_id, step_ms, round(ts_ms / 1000.0::DOUBLE, 6) AS value FROM v")),
    "offset": ("sum_over_time(events_value[6h] offset 1d)", _sql("SELECT event_type, user_id, step_ms, round(sum(value), 6) AS value FROM w GROUP BY ALL", w=_windows(offset=86_400_000))),
    "negative_offset": ("sum_over_time(events_value[6h] offset -1d)", _sql("SELECT event_type, user_id, step_ms, round(sum(value), 6) AS value FROM w GROUP BY ALL", w=_windows(offset=-86_400_000))),
    "at_end": ("sum by (event_type) (sum_over_time(events_value[6h] @ end()))", _sums(f"SELECT event_type, g.step_ms, round(value, 6) AS value FROM v, grid g WHERE v.step_ms = {END}000")),
    # range functions
    "rate": ("rate(events_total[6h])", _rate(True, True, TOTAL)),
    "rate_with_resets": ("rate(events_value[6h])", _rate(True, True)),
    "increase": ("increase(events_value[6h])", _rate(True, False)),
    "delta": ("delta(events_value[6h])", _rate(False, False)),
    "irate": ("irate(events_value[6h])", _pairs("CASE WHEN arg_max(value, ts_ms) < arg_max(pv, ts_ms) THEN arg_max(value, ts_ms) ELSE arg_max(value, ts_ms) - arg_max(pv, ts_ms) END / ((max(ts_ms) - arg_max(pt, ts_ms)) / 1000.0)", "HAVING arg_max(pt, ts_ms) > min(ws)")),
    "idelta": ("idelta(events_value[6h])", _pairs("arg_max(value, ts_ms) - arg_max(pv, ts_ms)", "HAVING arg_max(pt, ts_ms) > min(ws)")),
    "changes": ("changes(events_value[6h])", _pairs("count(*) FILTER (pt > ws AND value <> pv)")),
    "resets": ("resets(events_value[6h])", _pairs("count(*) FILTER (pt > ws AND value < pv)")),
    "sum_over_time": ("sum_over_time(events_value[6h])", _over("sum(value)")),
    "avg_over_time": ("avg_over_time(events_value[6h])", _over("avg(value)")),
    "min_over_time": ("min_over_time(events_value[6h])", _over("min(value)")),
    "max_over_time": ("max_over_time(events_value[6h])", _over("max(value)")),
    "count_over_time": ("count_over_time(events_value[6h])", _over("count(*)")),
    "last_over_time": ("last_over_time(events_value[6h])", _latest(NAMED)),
    "first_over_time": ("first_over_time(events_value[6h])", _over("arg_min(value, ts_ms)").replace("SELECT event_type, user_id, step_ms, round((arg", "SELECT 'events_value' AS __name__, event_type, user_id, step_ms, round((arg")),
    "present_over_time": ("present_over_time(events_value[6h])", _over("1")),
    "stddev_over_time": ("stddev_over_time(events_value[6h])", _over("stddev_pop(value)")),
    "stdvar_over_time": ("stdvar_over_time(events_value[6h])", _over("var_pop(value)")),
    "quantile_over_time": ("quantile_over_time(0.75, events_value[6h])", _over("quantile_cont(value, 0.75)")),
    "mad_over_time": ("mad_over_time(events_value[6h])", _over("mad(value)")),
    "deriv": ("deriv(events_value[6h]) * 1000", _over("CASE WHEN count(*) > 1 THEN CASE WHEN min(value) = max(value) THEN 0 ELSE regr_slope(value, (ts_ms - ws) / 1000.0) END END * 1000", "HAVING count(*) > 1")),
    "predict_linear": ("predict_linear(events_value[6h], 60) / 1000", _over("CASE WHEN min(value) = max(value) THEN min(value) ELSE regr_slope(value, (ts_ms - step_ms) / 1000.0) * 60 + regr_intercept(value, (ts_ms - step_ms) / 1000.0) END / 1000", "HAVING count(*) > 1")),
    "ts_of_last_over_time": ("ts_of_last_over_time(events_value[6h])", _over("max(ts_ms) / 1000.0")),
    "ts_of_max_over_time": ("ts_of_max_over_time(events_value[6h])", _sql("SELECT event_type, user_id, step_ms, round(max(ts_ms) FILTER (value = m) / 1000.0::DOUBLE, 6) AS value FROM (SELECT *, max(value) OVER (PARTITION BY event_type, user_id, step_ms) AS m FROM w) GROUP BY event_type, user_id, step_ms", w=_windows())),
    "absent_over_time": ('absent_over_time(events_value{user_id="1",event_type="click"}[6h])', _sql(f"SELECT 'click' AS event_type, '1' AS user_id, step_ms, 1.0::DOUBLE AS value FROM grid WHERE step_ms NOT IN (SELECT step_ms FROM w WHERE event_type = 'click' AND user_id = '1')", w=_windows())),
    "subquery": ("max_over_time(sum by (event_type) (sum_over_time(events_value[6h]))[1d:6h])", _sql("SELECT event_type, g.step_ms, round(max(v.value), 6) AS value FROM grid g JOIN v ON v.ts > g.step_ms - 86400000 AND v.ts <= g.step_ms GROUP BY ALL", fine=f"SELECT unnest(range({START}000 - 86400000, {END}000 + 1, 21600000)) AS step_ms", v=f"SELECT event_type, f.step_ms AS ts, sum(value) AS value FROM fine f JOIN s ON s.ts_ms > f.step_ms - {W} AND s.ts_ms <= f.step_ms GROUP BY ALL")),
    "ts_of_first_over_time": ("ts_of_first_over_time(events_value[6h])", _over("min(ts_ms) / 1000.0")),
    "ts_of_min_over_time": ("ts_of_min_over_time(events_value[6h])", _sql("SELECT event_type, user_id, step_ms, round(max(ts_ms) FILTER (value = m) / 1000.0::DOUBLE, 6) AS value FROM (SELECT *, min(value) OVER (PARTITION BY event_type, user_id, step_ms) AS m FROM w) GROUP BY event_type, user_id, step_ms", w=_windows())),
    "duration_expression": ("sum_over_time(events_value[2h * 3])", _over("sum(value)")),
    "at_time": ("sum by (event_type) (sum_over_time(events_value[6h] @ 1704240000))", _sums("SELECT event_type, g.step_ms, round(value, 6) AS value FROM v, grid g WHERE v.step_ms = 1704240000000")),
    "at_start": ("sum by (event_type) (sum_over_time(events_value[6h] @ start() offset -6h))", _sums(f"SELECT event_type, g.step_ms, round(value, 6) AS value FROM v, grid g WHERE v.step_ms = {START}000 + {W}")),
    # aggregations
    "sum": ("sum(events_value)", _latest("SELECT step_ms, round(sum(value), 6) AS value FROM v GROUP BY ALL")),
    "avg_by": ("avg by (event_type) (events_value)", _latest("SELECT event_type, step_ms, round(avg(value), 6) AS value FROM v GROUP BY ALL")),
    "count_without": ("count without (user_id) (events_value)", _latest("SELECT event_type, step_ms, count(*)::DOUBLE AS value FROM v GROUP BY ALL")),
    "min_by": ("min by (event_type) (events_value)", _latest("SELECT event_type, step_ms, round(min(value), 6) AS value FROM v GROUP BY ALL")),
    "max_by": ("max by (event_type) (events_value)", _latest("SELECT event_type, step_ms, round(max(value), 6) AS value FROM v GROUP BY ALL")),
    "group_by": ("group by (event_type) (events_value)", _latest("SELECT event_type, step_ms, 1.0::DOUBLE AS value FROM v GROUP BY ALL")),
    "stddev_by": ("stddev by (event_type) (events_value)", _latest("SELECT event_type, step_ms, round(stddev_pop(value), 6) AS value FROM v GROUP BY ALL")),
    "stdvar_by": ("stdvar by (event_type) (events_value) / 100000", _latest("SELECT event_type, step_ms, round(var_pop(value) / 100000, 6) AS value FROM v GROUP BY ALL")),
    "quantile_by": ("quantile by (event_type) (0.5, events_value)", _latest("SELECT event_type, step_ms, round(quantile_cont(value, 0.5), 6) AS value FROM v GROUP BY ALL")),
    "topk": (f"topk(2, {SUMS_QUERY})", _sums("SELECT event_type, step_ms, round(value, 6) AS value FROM v QUALIFY row_number() OVER (PARTITION BY step_ms ORDER BY value DESC) <= 2")),
    "bottomk": (f"bottomk(2, {SUMS_QUERY})", _sums("SELECT event_type, step_ms, round(value, 6) AS value FROM v QUALIFY row_number() OVER (PARTITION BY step_ms ORDER BY value) <= 2")),
    "count_values": ('count_values("n", count by (user_id) (events_value))', _latest("SELECT n::VARCHAR AS n, step_ms, count(*)::DOUBLE AS value FROM (SELECT user_id, step_ms, count(*) AS n FROM v GROUP BY ALL) GROUP BY ALL")),
    "limitk": ("count(limitk(3, events_value))", _latest("SELECT step_ms, least(count(*), 3)::DOUBLE AS value FROM v GROUP BY ALL")),
    "limit_ratio": ("count(limit_ratio(0.3, events_value) or limit_ratio(-0.7, events_value))", _latest("SELECT step_ms, count(*)::DOUBLE AS value FROM v GROUP BY ALL")),
    # binary operators
    "add_scalar": (f"{SUMS_QUERY} + 1", _each("value + 1")),
    "subtract_scalar": (f"100 - {SUMS_QUERY}", _each("100 - value")),
    "multiply_scalar": (f"{SUMS_QUERY} * 2", _each("value * 2")),
    "divide_by_zero": (f"{SUMS_QUERY} / 0", _each("'Infinity'::DOUBLE")),
    "modulo": (f"floor({SUMS_QUERY} + 0.005) % 7", _each("floor(value + 0.005) % 7")),
    "power": (f"({SUMS_QUERY} / 1000) ^ 2", _each("pow(value / 1000, 2)")),
    "atan2": (f"{SUMS_QUERY} atan2 ({SUMS_QUERY} / 2 + 100)", _each("atan2(value, value / 2 + 100)")),
    "negate": (f"-{SUMS_QUERY}", _each("-value")),
    "greater": (f"{SUMS_QUERY} > 1000", _each("value", "value > 1000")),
    "less_equal_bool": (f"{SUMS_QUERY} <= bool 1000", _each("CASE WHEN value <= 1000 THEN 1 ELSE 0 END")),
    "equal_bool_vectors": (f"floor({SUMS_QUERY} + 0.005) == bool floor(floor({SUMS_QUERY} + 0.005) / 2) * 2", _each("CASE WHEN floor(value + 0.005) = floor(floor(value + 0.005) / 2) * 2 THEN 1 ELSE 0 END")),
    "not_equal": (f"floor({SUMS_QUERY} + 0.005) % 7 != 0", _each("floor(value + 0.005) % 7", "floor(value + 0.005) % 7 <> 0")),
    "greater_than_time": (f"{SUMS_QUERY} > time() / 1000000", _each("value", "value > step_ms / 1000.0 / 1000000")),
    "vector_ratio": ("sum by (event_type) (rate(events_total[6h])) / on() group_left sum(rate(events_total[6h]))", f"SELECT event_type, step_ms, round(sum(value) / sum(sum(value)) OVER (PARTITION BY step_ms), 6) AS value FROM ({_rate(True, True, TOTAL, 15)}) GROUP BY event_type, step_ms"),
    "group_left": ("sum by (event_type, user_id) (sum_over_time(events_value[6h])) / on(event_type) group_left sum by (event_type) (sum_over_time(events_value[6h]))", _sums("SELECT u.event_type, u.user_id, u.step_ms, round(u.value / v.value, 9) AS value FROM (SELECT event_type, user_id, step_ms, sum(value) AS value FROM w GROUP BY ALL) u JOIN v USING (event_type, step_ms)")),
    "group_left_label": (f"{SUMS_QUERY} * on(event_type) group_left(kind) last_over_time(event_info[1d])", _sums("SELECT event_type, left(event_type, 1) AS kind, step_ms, round(value, 6) AS value FROM v JOIN (SELECT DISTINCT event_type, step_ms FROM (SELECT event_type, (epoch_us(ts) // 86400000000) * 86400000 AS day FROM events) i JOIN grid g ON i.day > g.step_ms - 86400000 AND i.day <= g.step_ms) USING (event_type, step_ms)")),
    "and": ("events_value and on(user_id) events_value{event_type=\"purchase\"}", _latest("SELECT 'events_value' AS __name__, event_type, user_id, step_ms, round(value, 6) AS value FROM v SEMI JOIN (SELECT user_id, step_ms FROM v WHERE event_type = 'purchase') p USING (user_id, step_ms)")),
    "unless": ("events_value unless on(user_id) events_value{event_type=\"purchase\"}", _latest("SELECT 'events_value' AS __name__, event_type, user_id, step_ms, round(value, 6) AS value FROM v ANTI JOIN (SELECT user_id, step_ms FROM v WHERE event_type = 'purchase') p USING (user_id, step_ms)")),
    "or": ("events_value{event_type=\"purchase\"} or on(user_id) events_value{event_type=\"click\"}", _latest("SELECT 'events_value' AS __name__, event_type, user_id, step_ms, round(value, 6) AS value FROM v WHERE event_type = 'purchase' UNION ALL SELECT 'events_value', event_type, user_id, step_ms, round(value, 6) FROM (SELECT * FROM v WHERE event_type = 'click') c ANTI JOIN (SELECT user_id, step_ms FROM v WHERE event_type = 'purchase') p USING (user_id, step_ms)")),
    "fill": ("sum by (user_id) (events_value{event_type=\"click\"}) - fill(0) sum by (user_id) (events_value{event_type=\"view\"})", _latest("SELECT user_id, step_ms, round(coalesce(a.value, 0) - coalesce(b.value, 0), 6) AS value FROM (SELECT * FROM v WHERE event_type = 'click') a FULL JOIN (SELECT * FROM v WHERE event_type = 'view') b USING (user_id, step_ms)")),
    "ignoring": ("sum by (event_type, user_id) (sum_over_time(events_value[6h])) / ignoring(user_id) group_left sum by (event_type) (sum_over_time(events_value[6h]))", _sums("SELECT u.event_type, u.user_id, u.step_ms, round(u.value / v.value, 9) AS value FROM (SELECT event_type, user_id, step_ms, sum(value) AS value FROM w GROUP BY ALL) u JOIN v USING (event_type, step_ms)")),
    "group_right": ("sum by (event_type) (sum_over_time(events_value[6h])) - on(event_type) group_right sum by (event_type, user_id) (sum_over_time(events_value[6h]))", _sums("SELECT u.event_type, u.user_id, u.step_ms, round(v.value - u.value, 6) AS value FROM (SELECT event_type, user_id, step_ms, sum(value) AS value FROM w GROUP BY ALL) u JOIN v USING (event_type, step_ms)")),
    "fill_left": ("sum by (user_id) (events_value{event_type=\"click\"}) - fill_left(0) sum by (user_id) (events_value{event_type=\"view\"})", _latest("SELECT user_id, step_ms, round(coalesce(a.value, 0) - b.value, 6) AS value FROM (SELECT * FROM v WHERE event_type = 'click') a RIGHT JOIN (SELECT * FROM v WHERE event_type = 'view') b USING (user_id, step_ms)")),
    "fill_right": ("sum by (user_id) (events_value{event_type=\"click\"}) - fill_right(1) sum by (user_id) (events_value{event_type=\"view\"})", _latest("SELECT user_id, step_ms, round(a.value - coalesce(b.value, 1), 6) AS value FROM (SELECT * FROM v WHERE event_type = 'click') a LEFT JOIN (SELECT * FROM v WHERE event_type = 'view') b USING (user_id, step_ms)")),
    # functions of numbers
    "ln": (f"ln({SUMS_QUERY})", _each("ln(value)")),
    "log2": (f"log2({SUMS_QUERY})", _each("log2(value)")),
    "log10": (f"log10({SUMS_QUERY})", _each("log10(value)")),
    "sqrt": (f"sqrt({SUMS_QUERY})", _each("sqrt(value)")),
    "exp": (f"exp({SUMS_QUERY} / 10000)", _each("exp(value / 10000)")),
    "ceil": (f"ceil({SUMS_QUERY} - 0.005)", _each("ceil(value - 0.005)")),
    "floor": (f"floor({SUMS_QUERY} + 0.005)", _each("floor(value + 0.005)")),
    "abs_sgn": (f"abs(1000 - {SUMS_QUERY}) + sgn(1000 - {SUMS_QUERY})", _each("abs(1000 - value) + sign(1000 - value)")),
    "round_to": (f"round({SUMS_QUERY} + 0.005, 10)", _each("floor((value + 0.005) / 10 + 0.5) * 10")),
    "clamp": (f"clamp({SUMS_QUERY}, 500, 1000)", _each("greatest(least(value, 1000), 500)")),
    "clamp_min": (f"clamp_min({SUMS_QUERY}, 500)", _each("greatest(value, 500)")),
    "clamp_max": (f"clamp_max({SUMS_QUERY}, 500)", _each("least(value, 500)")),
    "trigonometry": (f"sin({SUMS_QUERY} / 1000) + cos({SUMS_QUERY} / 1000) + atan({SUMS_QUERY})", _each("sin(value / 1000) + cos(value / 1000) + atan(value)")),
    "hyperbolic": (f"sinh({SUMS_QUERY} / 10000) + cosh({SUMS_QUERY} / 10000) + tanh({SUMS_QUERY} / 10000)", _each("sinh(value / 10000) + cosh(value / 10000) + tanh(value / 10000)")),
    "deg_rad": (f"deg({SUMS_QUERY} / 1000) + rad({SUMS_QUERY})", _each("degrees(value / 1000) + radians(value)")),
    "dates": ("hour() + 100 * day_of_month() + 10000 * day_of_week() + 100000 * month()", _sql("SELECT step_ms, (hour(t) + 100 * day(t) + 10000 * dayofweek(t) + 100000 * month(t))::DOUBLE AS value FROM (SELECT *, make_timestamp(step_ms * 1000) AS t FROM grid)")),
    "more_dates": ("minute() + 100 * day_of_year() + 100000 * days_in_month() + 10000000 * year()", _sql("SELECT step_ms, (minute(t) + 100 * dayofyear(t) + 100000 * day(last_day(t)) + 10000000 * year(t))::DOUBLE AS value FROM (SELECT *, make_timestamp(step_ms * 1000) AS t FROM grid)")),
    "more_trigonometry": (f"tan({SUMS_QUERY} / 10000000) + asin({SUMS_QUERY} / 10000000) + acos({SUMS_QUERY} / 10000000) + asinh({SUMS_QUERY}) + acosh({SUMS_QUERY} + 1) + atanh({SUMS_QUERY} / 10000000)", _each("tan(value / 10000000) + asin(value / 10000000) + acos(value / 10000000) + asinh(value) + acosh(value + 1) + atanh(value / 10000000)")),
    "grid_functions": ("start() + end() + step() + range() + 0 * time()", _sql(f"SELECT step_ms, {START + END + STEP + END - START}::DOUBLE AS value FROM grid")),
    "pi": ("vector(pi() * time() / 1000000000)", _sql("SELECT step_ms, round(pi() * (step_ms / 1000.0) / 1000000000, 6) AS value FROM grid")),
    "timestamp_of_expression": ("timestamp(sum(events_value))", _latest("SELECT DISTINCT step_ms, (step_ms / 1000.0)::DOUBLE AS value FROM v")),
    "scalar": (f"scalar(sum({SUMS_QUERY})) + time()", _sums("SELECT g.step_ms, round(coalesce(sum(v.value), 'NaN'::DOUBLE) + g.step_ms / 1000.0, 6) AS value FROM grid g LEFT JOIN v USING (step_ms) GROUP BY g.step_ms")),
    "vector": ("vector(time())", _sql("SELECT step_ms, step_ms / 1000.0::DOUBLE AS value FROM grid")),
    "absent": ('absent(events_value{event_type="purchase",user_id="3"})', _sql("SELECT 'purchase' AS event_type, '3' AS user_id, step_ms, 1.0::DOUBLE AS value FROM grid WHERE step_ms NOT IN (SELECT step_ms FROM w WHERE event_type = 'purchase' AND user_id = '3')", w=_windows())),
    "label_replace": (f'label_replace({SUMS_QUERY}, "first", "$1!", "event_type", "(.).*")', _sums("SELECT event_type, left(event_type, 1) || '!' AS first, step_ms, round(value, 6) AS value FROM v")),
    "label_join": (f'label_join({SUMS_QUERY}, "twice", "/", "event_type", "event_type")', _sums("SELECT event_type, event_type || '/' || event_type AS twice, step_ms, round(value, 6) AS value FROM v")),
    "histogram_quantile": ("histogram_quantile(0.5, value_bucket)", _sql("""SELECT event_type, step_ms, round(CASE WHEN r <= b10 THEN 10 * (r / b10) WHEN r <= b50 THEN 10 + 40 * ((r - b10) / (b50 - b10)) WHEN r <= b100 THEN 50 + 50 * ((r - b50) / (b100 - b50))
        WHEN r <= b200 THEN 100 + 100 * ((r - b100) / (b200 - b100)) ELSE 200 END, 6) AS value FROM (SELECT q.step_ms, b.*, 0.5::DOUBLE * n AS r FROM (SELECT * FROM grid, (SELECT DISTINCT event_type FROM b)) q ASOF JOIN b ON q.event_type = b.event_type AND q.step_ms >= b.h) WHERE h > step_ms - 21600000""", b=BUCKETS)),
    "histogram_fraction": ("histogram_fraction(0, 50, value_bucket)", _sql("SELECT event_type, step_ms, round(b50::DOUBLE / n, 6) AS value FROM (SELECT q.step_ms, b.* FROM (SELECT * FROM grid, (SELECT DISTINCT event_type FROM b)) q ASOF JOIN b ON q.event_type = b.event_type AND q.step_ms >= b.h) WHERE h > step_ms - 21600000", b=BUCKETS)),
    # a running count never falls, so the increase is the difference of the values at the edges
    "anchored": ("sum by (event_type) (increase(events_total[6h] anchored))", _sql("SELECT event_type, step_ms, round(sum(a.vn - coalesce(b.v, a.v0)), 6)::DOUBLE AS value FROM a LEFT JOIN b USING (event_type, user_id, step_ms) GROUP BY ALL", s=TOTAL, w=_windows(), a="SELECT event_type, user_id, step_ms, max(value) AS vn, min(value) AS v0 FROM w GROUP BY ALL", before=_windows(offset=W), b="SELECT event_type, user_id, step_ms, max(value) AS v FROM before GROUP BY ALL")),
    "smoothed": ("sum by (event_type) (rate(events_total[6h] smoothed))", _sql(f"SELECT event_type, step_ms, round(sum({_edge('e')} - {_edge('b')}) / {W / 1000}, 6) AS value FROM a GROUP BY ALL", s=TOTAL, w=_windows(width=3 * W, offset=-W),
        a=f"SELECT event_type, user_id, step_ms, ws + {W} AS b, ws + {2 * W} AS e, " + ", ".join(f"max(value) FILTER (ts_ms <= {t}) AS {k}v0, max(ts_ms) FILTER (ts_ms <= {t}) AS {k}t0, min(value) FILTER (ts_ms >= {t}) AS {k}v1, min(ts_ms) FILTER (ts_ms >= {t}) AS {k}t1" for k, t in (("b", f"ws + {W}"), ("e", f"ws + {2 * W}"))) + " FROM w GROUP BY ALL")),
    "double_exponential_smoothing": ("double_exponential_smoothing(events_value[1d], 0.5, 0.3)", None),
}
#: Daily queries over orders and lineitem: 1995 to 2001, all of both.
D_START, D_END, D_STEP = 788_918_400, 1_009_756_800, 86_400
DAILY_GRID = f"SELECT unnest(range({D_START}000, {D_END}000 + 1, {D_STEP}000)) AS step_ms"
DAILY: dict[str, tuple[str, str | None]] = {
    "order_totals": ("sum by (priority) (sum_over_time(order_totalprice[7d]))", f"WITH grid AS ({DAILY_GRID}) SELECT o_orderpriority AS priority, step_ms, round(sum(o_totalprice), 2) AS value FROM grid JOIN orders ON epoch_us(o_orderdate) // 1000 > step_ms - 604800000 AND epoch_us(o_orderdate) // 1000 <= step_ms GROUP BY ALL"),
    "ship_ratio": ('sum(sum_over_time(ship_quantity{flag="R"}[7d])) / sum(sum_over_time(ship_quantity[7d]))', f"WITH grid AS ({DAILY_GRID}) SELECT step_ms, round(sum(l_quantity) FILTER (l_returnflag = 'R') / sum(l_quantity), 6) AS value FROM grid JOIN lineitem ON epoch_us(l_shipdate) // 1000 > step_ms - 604800000 AND epoch_us(l_shipdate) // 1000 <= step_ms GROUP BY ALL HAVING count(*) FILTER (l_returnflag = 'R') > 0"),
}


#: Digits where not six: shares of sums of cents often lie half-way between two numbers of six.
DIGITS = {"group_left": 9, "ignoring": 9}
#: Instant queries at the end of the grid: the whole table by a range selector, and orders (of rows; the SQL has none).
AT_END = f"round(value, 6) AS value FROM v WHERE step_ms = {END}000"
INSTANT: dict[str, tuple[str, str | None]] = {
    "range_selector": ("events_value[31d]", _sql("SELECT 'events_value' AS __name__, event_type, user_id, ts_ms, round(value, 6) AS value FROM s")),
    "sort": (f"sort({SUMS_QUERY})", _sums(f"SELECT event_type, step_ms, {AT_END}")),
    "sort_desc": (f"sort_desc({SUMS_QUERY})", _sums(f"SELECT event_type, step_ms, {AT_END}")),
    "sort_by_label": (f'sort_by_label({SUMS_QUERY}, "event_type")', _sums(f"SELECT event_type, step_ms, {AT_END}")),
    "sort_by_label_desc": (f'sort_by_label_desc({SUMS_QUERY}, "event_type")', _sums(f"SELECT event_type, step_ms, {AT_END}")),
}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, catalog(spark, sf_dir), LOOKBACK, ParserOptions.everything())


def _run(query: str, start: int, end: int, step: int, digits: int = 6) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir).range_query(query, start, end, step)
        return df.withColumn("value", F.round("value", digits))

    return run


def _run_instant(query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).instant_query(query, END).withColumn("value", F.round("value", 6))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: _run(q, START, END, STEP, DIGITS.get(k, 6)) for k, (q, _) in QUERIES.items()}
    found |= {k: _run_instant(q) for k, (q, _) in INSTANT.items()}
    return found | {k: _run(q, D_START, D_END, D_STEP, 2 if k == "order_totals" else 6) for k, (q, _) in DAILY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in (QUERIES | INSTANT | DAILY).items() if s}
