"""DuckDB SQL with the same results as ``spark_queries``, written independently from the table roles."""

from __future__ import annotations

from statistics import NormalDist

from checks.roles import FUELS, MODELS, RING

LAGS = [23, 24, 25, 48, 72, 168, 336]
NIGHT = "(0,1,2,3,4,5,23)"
PEAK = "(8,9,17,18,19,20)"
LEVELS = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]


def r(expr: str, digits: int = 6) -> str:
    # the shift moves exact halves, which the engines round differently; adding 0.0 turns -0.0 into 0.0
    return f"round(({expr}) + 1e-9, {digits}) + 0.0"


def rr(names, digits: int = 6) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


def _q(name: str) -> str:
    return r(f'"{name}"')


# --- roles ---------------------------------------------------------------------------------------------------------

EV = """ev AS (SELECT event_id, event_type AS zone, date_trunc('hour', ts)::TIMESTAMP AS valid_time, ts, user_id, value FROM events)"""
S = EV + """, s AS (SELECT zone, valid_time, avg(value) AS price FROM ev GROUP BY 1, 2)"""
D = S + """, spine AS (SELECT zone, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS valid_time
 FROM (SELECT zone, min(valid_time) AS lo, max(valid_time) AS hi FROM s GROUP BY 1)),
 d AS (SELECT spine.zone, spine.valid_time, s.price FROM spine LEFT JOIN s USING (zone, valid_time))"""


def price_window(source: str, name: str) -> str:
    lags = ", ".join(f"lag(price, {h}) OVER w AS price_lag{h}h" for h in LAGS)

    def frame(hours):
        return f"(PARTITION BY zone ORDER BY valid_time ROWS BETWEEN {23 + hours} PRECEDING AND 24 PRECEDING)"

    return f"""{name} AS (SELECT *, {lags},
 avg(price) OVER {frame(24)} AS price_roll24h, avg(price) OVER {frame(168)} AS price_roll168h,
 stddev_samp(price) OVER {frame(168)} AS price_roll168h_std, stddev_samp(price) OVER {frame(720)} AS price_roll720h_std
 FROM {source} WINDOW w AS (PARTITION BY zone ORDER BY valid_time))"""


PF = D + ", " + price_window("d", "pf")
SC = PF + ", sc AS (" + " UNION ALL ".join(
    f"SELECT zone, valid_time, '{m}' AS model, price AS y, {c} - 1.645 * price_roll168h_std AS q05, {c} AS q50, "
    f"{c} + 1.645 * price_roll168h_std AS q95 FROM pf" for m, c in MODELS.items()) + ")"
ONE = SC + ", one AS (SELECT * EXCLUDE (model) FROM sc WHERE model = 'lgbm')"
V = EV + """, v AS (SELECT zone, CAST(20 + event_id % 3 AS INTEGER) AS series_id, valid_time, value,
 valid_time - INTERVAL 1 HOUR * ((event_id * 7) % 73) AS knowledge_time,
 CASE WHEN value < 20 THEN 'short' WHEN value < 60 THEN 'medium' ELSE 'forever' END AS retention FROM ev)"""

HOLIDAY_MD = "('01-01','01-06','05-01','12-25','12-26','12-24','12-31','06-06')"


def calendar(t: str = "valid_time") -> dict[str, str]:
    # the events lie in January; the fixed-date holidays are the ones that can occur
    hour, wd, mo = f"hour({t})", f"(isodow({t}) - 1)", f"month({t})"
    weekend = f"CASE WHEN {wd} >= 5 THEN 1 ELSE 0 END"
    return {
        "hour": hour, "weekday": wd, "month": mo, "is_weekend": weekend,
        "is_holiday": f"CASE WHEN strftime({t}, '%m-%d') IN {HOLIDAY_MD} THEN 1 ELSE 0 END",
        "hour_of_week": f"{wd} * 24 + {hour}",
        "hour_sin": f"sin(2 * pi() * {hour} / 24)", "hour_cos": f"cos(2 * pi() * {hour} / 24)",
        "weekday_sin": f"sin(2 * pi() * {wd} / 7)", "weekday_cos": f"cos(2 * pi() * {wd} / 7)",
        "month_sin": f"sin(2 * pi() * ({mo} - 1) / 12)", "month_cos": f"cos(2 * pi() * ({mo} - 1) / 12)",
        "hour_x_month": f"{hour} * {mo}", "weekend_x_hour": f"({weekend}) * sin(2 * pi() * {hour} / 24)",
    }


INTS = ["hour", "weekday", "month", "is_weekend", "is_holiday", "hour_of_week", "hour_x_month"]


def calendar_select(t: str = "valid_time") -> str:
    return ", ".join(f"CAST({e} AS BIGINT) AS {n}" if n in INTS else f"{r(e)} AS {n}" for n, e in calendar(t).items())


WEATHER = """wx AS (SELECT zone, valid_time, CASE WHEN count(*) >= 2 THEN min(value) END AS temperature,
 CASE WHEN count(*) >= 2 THEN max(value) END AS wind_speed, CASE WHEN count(*) >= 2 THEN avg(user_id) END AS irradiance
 FROM ev GROUP BY 1, 2)"""
_next = "CASE zone " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RING) + " END"
GRID = f"""gen AS (SELECT zone, valid_time, sum(least(value, 50)) AS wind_mw, sum(greatest(value - 50, 0)) AS solar_mw FROM ev GROUP BY 1, 2),
 ld AS (SELECT zone, valid_time, sum(value) AS load_mw FROM ev GROUP BY 1, 2),
 ring AS (SELECT valid_time, zone AS from_zone, {_next} AS to_zone, value AS value_mw FROM ev),
 imp AS (SELECT to_zone AS zone, valid_time, sum(value_mw) AS i FROM ring GROUP BY 1, 2),
 exx AS (SELECT from_zone AS zone, valid_time, sum(value_mw) AS e FROM ring GROUP BY 1, 2),
 nx AS (SELECT zone, valid_time, coalesce(i, 0) - coalesce(e, 0) AS net_exchange_mw FROM imp FULL JOIN exx USING (zone, valid_time))"""


def fill(c: str) -> str:
    return f"last_value({c} IGNORE NULLS) OVER (PARTITION BY zone ORDER BY valid_time ROWS UNBOUNDED PRECEDING) AS {c}"


def matrix(axis: str) -> str:
    """Matrix CTEs over an ``axis`` CTE with (zone, valid_time)."""
    return f"""{WEATHER}, {GRID},
 md AS (SELECT a.zone, a.valid_time, s.price FROM {axis} a LEFT JOIN s USING (zone, valid_time)), {price_window('md', 'mp')},
 mw AS (SELECT a.zone, a.valid_time, {fill('temperature')}, {fill('wind_speed')}, {fill('irradiance')}
  FROM {axis} a LEFT JOIN wx USING (zone, valid_time)),
 mx AS (SELECT mp.*, temperature, wind_speed, irradiance, wind_mw, solar_mw, load_mw, net_exchange_mw FROM mp
  JOIN mw USING (zone, valid_time) LEFT JOIN gen USING (zone, valid_time) LEFT JOIN ld USING (zone, valid_time)
  LEFT JOIN nx USING (zone, valid_time))"""


PRICE_COLS = ["price"] + [f"price_lag{h}h" for h in LAGS] + ["price_roll24h", "price_roll168h", "price_roll168h_std", "price_roll720h_std"]
MATRIX_SELECT = (
    f"SELECT zone, valid_time, {rr(PRICE_COLS)}, {calendar_select()}, {rr(['temperature', 'wind_speed', 'irradiance'])}, "
    f"{r('temperature * wind_speed')} AS temp_x_wind, {r('temperature * hour(valid_time)')} AS temp_x_hour, "
    f"{rr(['wind_mw', 'solar_mw', 'load_mw', 'net_exchange_mw'])} FROM mx"
)

# --- region tables ---
FUEL_CASES = {v: f"sum(l_quantity - 15) FILTER (WHERE l_returnflag = '{k}')" for k, v in FUELS.items()}
FUEL = "fuel AS (SELECT l_shipdate AS valid_time, l_linestatus AS zone, " + ", ".join(
    f'{e} AS "{n}"' for n, e in FUEL_CASES.items()) + " FROM lineitem GROUP BY 1, 2)"
RLOAD = """nr AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
 rl AS (SELECT o_orderdate AS valid_time, r_name AS zone, sum(o_totalprice - 150000) AS value_mw FROM orders
 JOIN customer ON o_custkey = c_custkey JOIN nr ON c_nationkey = n_nationkey GROUP BY 1, 2)"""
RFLOW = """nr AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
 rf AS (SELECT o_orderdate AS valid_time, a.r_name AS from_zone, b.r_name AS to_zone, sum(l_quantity) AS value_mw
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
 JOIN nr a ON s_nationkey = a.n_nationkey JOIN nr b ON c_nationkey = b.n_nationkey GROUP BY 1, 2, 3)"""


def quality(source: str, suite: str, rules: list[tuple[str, str, str]], dup: str | None = None) -> str:
    """Rules are (column, expectation, SQL for failing rows)."""
    parts = [
        f"SELECT '{suite}' AS suite, '{c}' AS \"column\", '{e}' AS expectation, (SELECT count(*) FROM {source}) AS n_rows, "
        f"CAST(({f}) AS BIGINT) AS n_failed" for c, e, f in rules
    ]
    return "SELECT *, n_failed = 0 AS success FROM (" + " UNION ALL ".join(parts) + ")"


def failing(source: str, cond: str) -> str:
    return f"SELECT count(*) FROM {source} WHERE {cond}"


# --- scores --------------------------------------------------------------------------------------------------------

SIGMA = "(CASE WHEN q05 IS NOT NULL AND q95 IS NOT NULL THEN greatest((q95 - q05) / 3.29, 1e-3) END)"


def pinball(q: str, f: str) -> str:
    return f"CASE WHEN y >= {f} THEN {q} * (y - {f}) ELSE (1 - {q}) * ({f} - y) END"


def two(value: str, cond: str) -> str:
    return f"CASE WHEN count(*) FILTER (WHERE {cond}) >= 2 THEN avg({value}) FILTER (WHERE {cond}) END"


P50 = "y IS NOT NULL AND q50 IS NOT NULL"
P05 = "y IS NOT NULL AND q05 IS NOT NULL"
P95 = "y IS NOT NULL AND q95 IS NOT NULL"
PIN = "y IS NOT NULL AND q05 IS NOT NULL AND q95 IS NOT NULL"
HIT = "CASE WHEN y >= q05 AND y <= q95 THEN 1.0 ELSE 0.0 END"
POINT = {
    "mae_eur": two("abs(y - q50)", P50),
    "pinball_q50": two(pinball("0.5", "q50"), P50),
    "pinball_q05": two(pinball("0.05", "q05"), P05),
    "pinball_q95": two(pinball("0.95", "q95"), P95),
    "coverage_rate": two(HIT, PIN),
}


def named(cols: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"{r(e, digits)} AS {n}" for n, e in cols.items())


def raw(cols: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in cols.items())


HOLD = {
    "mae": "avg(abs(q50 - y))",
    "rmse": "sqrt(avg((q50 - y) * (q50 - y)))",
    "mape": "coalesce(avg(abs((q50 - y) / y) * 100) FILTER (WHERE abs(y) >= 1), 0)",
    "coverage_q5_q95": f"avg({HIT}) * 100",
    "spike_mae": "coalesce(avg(abs(q50 - y)) FILTER (WHERE y > 100), 0)",
    "night_mae": f"coalesce(avg(abs(q50 - y)) FILTER (WHERE hour(valid_time) IN {NIGHT}), 0)",
    "peak_mae": f"coalesce(avg(abs(q50 - y)) FILTER (WHERE hour(valid_time) IN {PEAK}), 0)",
}
HM = f"hm AS (SELECT zone, model, count(*) AS n_hours, count(*) FILTER (WHERE y > 100) AS n_spikes, {raw(HOLD)} FROM sc WHERE {P50} GROUP BY 1, 2)"

_z = f"((y - q50) / {SIGMA})"
_x = f"({_z} / sqrt(2))"
_t = f"(1.0 / (1.0 + 0.3275911 * abs({_x})))"
ERF = (f"(sign({_x}) * (1.0 - {_t} * (0.254829592 + {_t} * (-0.284496736 + {_t} * (1.421413741 + {_t} * (-1.453152027 + "
       f"{_t} * 1.061405429)))) * exp(-({_x}) * ({_x}))))")
CRPS = f"({SIGMA} * ({_z} * {ERF} + 2.0 * exp(-0.5 * {_z} * {_z}) / sqrt(2 * pi()) - 1.0 / sqrt(pi())))"
EVAL = {
    "crps": f"avg({CRPS})",
    "mae": "avg(abs(y - q50))",
    "spike_mae": "avg(abs(y - q50)) FILTER (WHERE y > 100)",
    "coverage": f"avg({HIT})",
    "interval_width": "avg(q95 - q05)",
}
REL = " UNION ALL ".join(
    "SELECT {keys}, %s AS nominal, avg(CASE WHEN y <= q50 + %s * (%r) THEN 1.0 WHEN y > q50 + %s * (%r) THEN 0.0 END) AS observed "
    "FROM {src} WHERE %s GROUP BY ALL" % (p, SIGMA, NormalDist().inv_cdf(p), SIGMA, NormalDist().inv_cdf(p), P50) for p in LEVELS)

# folds: 14 training days, 3 test days, step 3, as long as the test days fit into the days of the series
FOLDS = """folds AS (SELECT CAST(k AS INTEGER) AS fold, lo + INTERVAL 1 DAY * (3 * k) AS train_start,
 lo + INTERVAL 1 DAY * (3 * k + 14) AS train_end, lo + INTERVAL 1 DAY * (3 * k + 14) AS test_start,
 lo + INTERVAL 1 DAY * (3 * k + 17) AS test_end
 FROM (SELECT date_trunc('day', min(valid_time))::TIMESTAMP AS lo, date_trunc('day', max(valid_time))::TIMESTAMP + INTERVAL 1 DAY AS hi FROM s),
 range(0, 100000) t(k) WHERE lo + INTERVAL 1 DAY * (3 * k + 17) <= hi)"""
FSC = SC + ", " + FOLDS + ", fsc AS (SELECT sc.*, fold FROM sc JOIN folds ON valid_time >= test_start AND valid_time < test_end)"
FM = FSC + f", fm AS (SELECT zone, fold, model, {raw(EVAL)} FROM fsc WHERE {P50} GROUP BY 1, 2, 3)"

CONF = """cs AS (SELECT zone, model, greatest(q05 - y, y - q95) AS score FROM sc WHERE y IS NOT NULL AND q05 IS NOT NULL AND q95 IS NOT NULL),
 cr AS (SELECT zone, model, score, row_number() OVER (PARTITION BY zone, model ORDER BY score) - 1 AS rk, count(*) OVER (PARTITION BY zone, model) AS n FROM cs),
 cl AS (SELECT *, least(ceil((n + 1) * {cov}) / n, 1.0) * (n - 1) AS pos FROM cr),
 cf AS (SELECT zone, model, max(n) AS n_calibration, avg(CASE WHEN score <= 0 THEN 1.0 ELSE 0.0 END) AS raw_coverage,
  max(score) FILTER (WHERE rk = floor(pos)) + max(pos - floor(pos)) * (max(score) FILTER (WHERE rk = ceil(pos)) - max(score) FILTER (WHERE rk = floor(pos))) AS correction
  FROM cl GROUP BY 1, 2)"""

BASE = "base AS (SELECT zone, valid_time, " + ", ".join(
    f"max({q}) FILTER (WHERE model = '{m}') AS {m}_{q}" for m in ("lgbm", "xgb", "cat") for q in ("q05", "q50", "q95")
) + " FROM sc WHERE model IN ('lgbm', 'xgb', 'cat') GROUP BY 1, 2)"


def ridge(q: str) -> str:
    """3x3 ridge by Cramer's rule on centred moments."""
    a, b, c = f"lgbm_{q}", f"xgb_{q}", f"cat_{q}"
    m = f"""m{q} AS (SELECT zone, count(*) AS n, avg(price) AS my, avg({a}) AS ma, avg({b}) AS mb, avg({c}) AS mc,
 count(*) * var_pop({a}) + 1 AS aa, count(*) * var_pop({b}) + 1 AS bb, count(*) * var_pop({c}) + 1 AS cc,
 count(*) * covar_pop({a}, {b}) AS ab, count(*) * covar_pop({a}, {c}) AS ac, count(*) * covar_pop({b}, {c}) AS bc,
 count(*) * covar_pop({a}, price) AS ay, count(*) * covar_pop({b}, price) AS by_, count(*) * covar_pop({c}, price) AS cy
 FROM base JOIN s USING (zone, valid_time) WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND {c} IS NOT NULL AND price IS NOT NULL GROUP BY 1)"""
    det = "(aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac))"
    wa = f"(ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / {det}"
    wb = f"(aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / {det}"
    wc = f"(aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / {det}"
    return m + f""", r{q} AS (SELECT zone, '{q}' AS quantile, n, my - w_lgbm * ma - w_xgb * mb - w_cat * mc AS intercept, w_lgbm, w_xgb, w_cat
 FROM (SELECT *, {wa} AS w_lgbm, {wb} AS w_xgb, {wc} AS w_cat FROM m{q}))"""


RIDGE = SC + ", " + BASE + ", " + ", ".join(ridge(q) for q in ("q05", "q50", "q95"))
ENS = ", ".join(
    f"r{q}.intercept + r{q}.w_lgbm * lgbm_{q} + r{q}.w_xgb * xgb_{q} + r{q}.w_cat * cat_{q} AS e{q}" for q in ("q05", "q50", "q95"))

TAIL = ONE + """, tail AS (SELECT zone, valid_time, price AS y, lag(price, 24) OVER (PARTITION BY zone ORDER BY valid_time) AS naive
 FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY valid_time DESC) AS k FROM s) WHERE k <= 168),
 ta AS (SELECT tail.*, q05, q50, q95 FROM tail LEFT JOIN (SELECT zone, valid_time, q05, q50, q95 FROM one) USING (zone, valid_time)),
 rm AS (SELECT zone, """ + raw(POINT) + ", " + two("abs(y - naive)", "y IS NOT NULL AND naive IS NOT NULL") + f""" AS naive_mae_eur,
 count(*) FILTER (WHERE {P50}) AS n_hours FROM ta GROUP BY 1),
 bl AS (SELECT zone, """ + POINT["pinball_q50"] + """ AS baseline_pinball_q50 FROM (SELECT k.zone, k.price AS y, q50 FROM
 (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY valid_time DESC) AS k FROM s) k LEFT JOIN (SELECT zone, valid_time, q50 FROM one) USING (zone, valid_time)
 WHERE k.k <= 480) GROUP BY 1),
 al AS (SELECT rm.*, baseline_pinball_q50, CASE WHEN naive_mae_eur <> 0 THEN mae_eur / naive_mae_eur END AS rmae,
  0.9 + 0.1 * i AS rmae_max, 0.8 + 0.2 * i AS mult, 0.80 + 0.04 * i AS cmin, 0.9 AS cmax
  FROM rm LEFT JOIN bl USING (zone) JOIN (VALUES """ + ", ".join(f"('{z}', {i})" for i, (z, _) in enumerate(RING)) + """) t(zone, i) USING (zone)),
 alerts AS (SELECT zone, 'rmae' AS metric, rmae AS value, rmae_max AS threshold FROM al WHERE n_hours >= 48 AND rmae > rmae_max
  UNION ALL SELECT zone, 'pinball_q50', pinball_q50, round(mult * baseline_pinball_q50, 4) FROM al WHERE n_hours >= 48 AND baseline_pinball_q50 > 0 AND pinball_q50 > mult * baseline_pinball_q50
  UNION ALL SELECT zone, 'coverage_rate', coverage_rate, cmin FROM al WHERE n_hours >= 48 AND coverage_rate < cmin
  UNION ALL SELECT zone, 'coverage_rate', coverage_rate, cmax FROM al WHERE n_hours >= 48 AND NOT coverage_rate < cmin AND coverage_rate > cmax)"""

LATEST = "SELECT zone, series_id, valid_time, (max({'k': knowledge_time, 'v': value})).v AS value, max(knowledge_time) AS knowledge_time FROM %s GROUP BY 1, 2, 3"
GATE = "knowledge_time <= date_trunc('day', valid_time) - INTERVAL 12 HOUR"


def newest(series: int) -> str:
    return f"(max({{'k': knowledge_time, 'v': value}}) FILTER (WHERE series_id = {series})).v"


def best_split(rows: str, name: str) -> str:
    """CTEs up to ``name``: for every zone, quantile and node of ``rows`` the feature and cut with the largest gain."""
    part = "PARTITION BY zone, q, node, f"
    gain = " + ".join(f"{sign}pow(greatest(abs({g}) - 0.3, 0), 2) / ({n} + 0.3)" for sign, g, n in (
        ("", "gl", "nl"), ("", "ga - gl", "na - nl"), ("-1 * ", "ga", "na")))
    return f"""{name}l AS (SELECT zone, q, node, 0 AS f, f0 AS v, g FROM {rows} WHERE node >= 0 UNION ALL SELECT zone, q, node, 1, f1, g FROM {rows} WHERE node >= 0),
 {name}h AS (SELECT zone, q, node, f, v, sum(g) AS g, count(*) AS n FROM {name}l GROUP BY 1, 2, 3, 4, 5),
 {name}w AS (SELECT *, sum(g) OVER ({part} ORDER BY v) AS gl, sum(n) OVER ({part} ORDER BY v) AS nl, sum(g) OVER ({part}) AS ga, sum(n) OVER ({part}) AS na FROM {name}h),
 {name}g AS (SELECT zone, q, node, f, v, round({gain}, 9) AS gain FROM {name}w WHERE nl >= 24 AND na - nl >= 24),
 {name} AS (SELECT zone, q, node, first(f ORDER BY gain DESC, f, v) AS f, first(v ORDER BY gain DESC, f, v) AS v FROM {name}g WHERE gain > 1e-9 GROUP BY 1, 2, 3)"""


ORACLE = {
    "hourly_series": f"WITH {S} SELECT zone, valid_time, {r('price')} AS price FROM s",
    "spine_reindex": f"WITH {D} SELECT zone, valid_time, {r('price')} AS price FROM d",
    "price_lags": f"WITH {PF} SELECT zone, valid_time, {rr(['price'] + [f'price_lag{h}h' for h in LAGS])} FROM pf",
    "rolling_stats": f"WITH {PF} SELECT zone, valid_time, {rr(PRICE_COLS[-4:])} FROM pf",
    "calendar_features": f"WITH {D} SELECT zone, valid_time, {calendar_select()} FROM d",
    "weather_ffill": f"""WITH {EV}, {WEATHER}, sp AS (SELECT zone, unnest(generate_series(min(valid_time), max(valid_time), INTERVAL 1 HOUR)) AS valid_time FROM ev GROUP BY zone),
 f AS (SELECT sp.zone, sp.valid_time, {fill('temperature')}, {fill('wind_speed')}, {fill('irradiance')} FROM sp LEFT JOIN wx USING (zone, valid_time))
 SELECT zone, valid_time, {rr(['temperature', 'wind_speed', 'irradiance'])}, {r('temperature * wind_speed')} AS temp_x_wind,
 {r('temperature * hour(valid_time)')} AS temp_x_hour FROM f""",
    "feature_matrix": f"WITH {D}, {matrix('spine')} {MATRIX_SELECT}",
    "inference_slice": f"""WITH {S}, ax AS (SELECT zone, unnest(generate_series(TIMESTAMP '2024-01-29' - INTERVAL 750 HOUR, TIMESTAMP '2024-01-29 23:00', INTERVAL 1 HOUR)) AS valid_time
 FROM (SELECT DISTINCT zone FROM s)), {matrix('ax')} {MATRIX_SELECT} WHERE valid_time >= TIMESTAMP '2024-01-29'""",
    "silver_generation": f"""WITH {FUEL}, t AS (SELECT valid_time, zone, coalesce("Wind Onshore", 0) + coalesce("Solar", 0) + coalesce("Nuclear", 0) AS total_mw,
 coalesce("Wind Onshore", 0) AS wind_mw, coalesce("Solar", 0) AS solar_mw FROM fuel)
 SELECT valid_time, zone, {rr(['total_mw', 'wind_mw', 'solar_mw'])} FROM t WHERE total_mw >= 0 AND wind_mw >= 0 AND solar_mw >= 0""",
    "silver_load": f"WITH {RLOAD} SELECT valid_time, zone, {r('value_mw', 2)} AS value_mw FROM rl WHERE value_mw > 0",
    "silver_crossborder": f"WITH {RFLOW} SELECT valid_time, from_zone, to_zone, {r('value_mw')} AS value_mw FROM rf",
    "net_exchange": f"""WITH {RFLOW}, i AS (SELECT to_zone AS zone, valid_time, sum(value_mw) AS v FROM rf GROUP BY 1, 2), e AS (SELECT from_zone AS zone, valid_time, sum(value_mw) AS w FROM rf GROUP BY 1, 2)
 SELECT zone, valid_time, {r('coalesce(v, 0) - coalesce(w, 0)')} AS net_exchange_mw FROM i FULL JOIN e USING (zone, valid_time)""",
    "imports_exports": f"""WITH {RFLOW}, i AS (SELECT to_zone AS zone, valid_time, sum(value_mw) AS v FROM rf GROUP BY 1, 2), e AS (SELECT from_zone AS zone, valid_time, sum(value_mw) AS w FROM rf GROUP BY 1, 2)
 SELECT zone, valid_time, {r('v')} AS imports_mw, {r('w')} AS exports_mw FROM i FULL JOIN e USING (zone, valid_time)""",
    "dq_prices": f"WITH {EV} " + quality("ev", "prices", [
        ("valid_time", "exists", "0"), ("value", "exists", "0"), ("zone", "exists", "0"),
        ("valid_time", "not_null", failing("ev", "valid_time IS NULL")), ("value", "not_null", failing("ev", "value IS NULL")),
        ("value", "between", failing("ev", "value < -500 OR value > 5000")), ("zone", "not_null", failing("ev", "zone IS NULL")),
        ("valid_time", "unique", "SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM ev WHERE valid_time IS NOT NULL GROUP BY zone, valid_time HAVING count(*) > 1)"),
    ]),
    "dq_weather": f"""WITH {EV}, {WEATHER}, sp AS (SELECT zone, unnest(generate_series(min(valid_time), max(valid_time), INTERVAL 1 HOUR)) AS valid_time FROM ev GROUP BY zone),
 w AS (SELECT sp.zone, sp.valid_time, temperature, wind_speed, irradiance FROM sp LEFT JOIN wx USING (zone, valid_time)) """ + quality("w", "weather", [
        *[(c, "exists", "0") for c in ("valid_time", "temperature_2m", "wind_speed_10m", "shortwave_radiation", "zone")],
        ("valid_time", "not_null", failing("w", "valid_time IS NULL")), ("temperature_2m", "not_null", failing("w", "temperature IS NULL")),
        ("wind_speed_10m", "not_null", failing("w", "wind_speed IS NULL")), ("shortwave_radiation", "not_null", failing("w", "irradiance IS NULL")),
        ("zone", "not_null", failing("w", "zone IS NULL")), ("temperature_2m", "between", failing("w", "temperature < -50 OR temperature > 60")),
        ("wind_speed_10m", "between", failing("w", "wind_speed < 0")), ("shortwave_radiation", "between", failing("w", "irradiance < 0")),
    ]),
    "dq_generation": f"WITH {FUEL} " + quality("fuel", "generation", [
        ("valid_time", "exists", "0"), ("zone", "exists", "0"), ("*", "column_count", "0"),
        ("valid_time", "not_null", failing("fuel", "valid_time IS NULL")), ("zone", "not_null", failing("fuel", "zone IS NULL")),
        *[(f, "between", failing("fuel", f'"{f}" < 0')) for f in FUELS.values()],
    ]),
    "dq_silver_load": f"WITH {RLOAD}, sl AS (SELECT * FROM rl WHERE value_mw > 0) " + quality("sl", "silver_load", [
        *[(c, "exists", "0") for c in ("valid_time", "zone", "value_mw")],
        *[(c, "not_null", failing("sl", f"{c} IS NULL")) for c in ("valid_time", "zone", "value_mw")],
    ]),
    "read_latest": f"WITH {V} " + LATEST % "v",
    "read_latest_wide": f"WITH {V} SELECT zone, valid_time, {newest(20)} AS lgbm_q05, {newest(21)} AS lgbm_q50, {newest(22)} AS lgbm_q95 FROM v GROUP BY 1, 2",
    "read_versions": f"WITH {V} SELECT zone, series_id, valid_time, value, knowledge_time, CASE series_id WHEN 20 THEN 'lgbm_q05' WHEN 21 THEN 'lgbm_q50' ELSE 'lgbm_q95' END AS name FROM v",
    "read_as_of": f"WITH {V} " + LATEST % "v WHERE knowledge_time < TIMESTAMP '2024-01-15 23:59' AND valid_time >= TIMESTAMP '2024-01-03' AND valid_time < TIMESTAMP '2024-01-21'",
    "read_relative": f"WITH {V} " + LATEST % f"v WHERE {GATE}",
    "provenance": f"WITH {V} SELECT zone, knowledge_time, min(valid_time) AS first_valid_time, max(valid_time) AS last_valid_time, count(valid_time) AS hours_stored FROM v GROUP BY 1, 2",
    "retention": f"""WITH {V} SELECT zone, series_id, valid_time, value, knowledge_time, retention FROM v
 WHERE CASE retention WHEN 'short' THEN valid_time >= TIMESTAMP '2024-01-24' WHEN 'medium' THEN valid_time >= TIMESTAMP '2024-01-11' ELSE true END""",
    "pit_join": f"""WITH {PF} SELECT e.event_id, e.zone, e.ts AS valid_time, {r('e.value')} AS price,
 CASE WHEN e.ts - f.valid_time <= INTERVAL 30 DAY THEN {r('f.price_lag24h')} END AS price_lag24h,
 CASE WHEN e.ts - f.valid_time <= INTERVAL 30 DAY THEN {r('f.price_roll24h')} END AS price_roll24h,
 CASE WHEN e.ts - f.valid_time <= INTERVAL 30 DAY THEN CAST(hour(f.valid_time) AS BIGINT) END AS hour
 FROM ev e ASOF LEFT JOIN pf f ON e.zone = f.zone AND e.ts >= f.valid_time""",
    "pit_join_ttl": f"""WITH {S}, f AS (SELECT zone, valid_time + INTERVAL 1 HOUR AS valid_time, price FROM s)
 SELECT e.event_id, e.zone, e.ts AS valid_time, {r('e.value')} AS price,
 CASE WHEN e.ts - f.valid_time <= INTERVAL 1 HOUR THEN {r('f.price')} END AS last_price
 FROM ev e ASOF LEFT JOIN f ON e.zone = f.zone AND e.ts >= f.valid_time""",
    "online_latest": f"""WITH {PF}, asked AS (SELECT DISTINCT zone FROM ev UNION ALL SELECT DISTINCT zone || '_unknown' FROM ev),
 l AS (SELECT * FROM pf QUALIFY row_number() OVER (PARTITION BY zone ORDER BY valid_time DESC) = 1)
 SELECT asked.zone, l.valid_time, {r('price_lag24h')} AS price_lag24h, {r('price_roll24h')} AS price_roll24h, CAST(hour(l.valid_time) AS BIGINT) AS hour
 FROM asked LEFT JOIN l USING (zone)""",
    "feature_views": f"WITH {D}, {matrix('spine')}, m AS ({MATRIX_SELECT}) SELECT zone, valid_time, "
    + ", ".join([f"price_lag{h}h" for h in LAGS]) + ", price_roll24h AS price_roll24h_mean, price_roll168h AS price_roll168h_mean, price_roll168h_std, price_roll720h_std, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c == "hour_x_month" else c for c in calendar())
    + ", temperature AS temperature_2m, wind_speed AS wind_speed_10m, irradiance AS solar_radiation, temp_x_wind, temp_x_hour, wind_mw, solar_mw, load_mw, net_exchange_mw FROM m",
    "metric_bundle": f"""WITH {TAIL} SELECT zone, {rr(['mae_eur', 'naive_mae_eur'])}, {r('CASE WHEN naive_mae_eur <> 0 THEN mae_eur / naive_mae_eur END')} AS rmae,
 {rr(['pinball_q50', 'pinball_q05', 'pinball_q95', 'coverage_rate'])}, n_hours FROM rm""",
    "point_metrics": f"WITH {SC} SELECT zone, model, {named(POINT)} FROM sc GROUP BY 1, 2",
    "baseline_pinball": f"WITH {TAIL} SELECT zone, {r('baseline_pinball_q50')} AS baseline_pinball_q50 FROM bl",
    "holdout_metrics": f"WITH {SC}, {HM} SELECT zone, model, n_hours, {rr(HOLD)}, n_spikes FROM hm",
    "mae_by_hour": f"WITH {SC} SELECT zone, model, hour(valid_time) AS hour, {r('avg(abs(q50 - y))')} AS mae FROM sc WHERE {P50} GROUP BY 1, 2, 3",
    "daily_mae": f"WITH {SC} SELECT zone, model, date_trunc('day', valid_time)::TIMESTAMP AS day, {r('avg(abs(q50 - y))')} AS mae FROM sc WHERE {P50} GROUP BY 1, 2, 3",
    "error_histogram": f"""WITH {SC}, e AS (SELECT zone, model, q50 - y AS err FROM sc WHERE {P50}), sp AS (SELECT zone, model, min(err) AS lo, (max(err) - min(err)) / 40 AS w FROM e GROUP BY 1, 2),
 b AS (SELECT zone, model, lo, w, CAST(least(CASE WHEN w > 0 THEN floor((err - lo) / w) ELSE 0 END, 39) AS BIGINT) AS bin FROM e JOIN sp USING (zone, model))
 SELECT zone, model, bin, {r('min(lo) + bin * min(w)')} AS left_edge, count(*) AS n FROM b GROUP BY 1, 2, 3""",
    "price_statistics": f"WITH {S} SELECT zone, {r('avg(price)')} AS mean, {r('max(price)')} AS max, {r('min(price)')} AS min, {r('stddev_samp(price)')} AS std FROM s GROUP BY 1",
    "forecast_kpis": f"""WITH {ONE}, l AS (SELECT * FROM one WHERE q50 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY zone ORDER BY valid_time DESC) <= 24)
 SELECT zone, {r('avg(q50)')} AS mean_q50, {r('max(q50)')} AS peak_q50, (SELECT min(valid_time) FROM l l2 WHERE l2.zone = l.zone AND l2.q50 = max(l.q50)) AS peak_time,
 {r('min(q50) FILTER (WHERE hour(valid_time) <= 5)')} AS overnight_low, {r('avg((q95 - q05) / 2)')} AS half_width FROM l GROUP BY zone""",
    "last_forecasts": f"WITH {ONE} SELECT zone, valid_time, {rr(['y', 'q05', 'q50', 'q95'])} FROM (SELECT * FROM one WHERE q50 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY zone ORDER BY valid_time DESC) <= 24)",
    "spike_analysis": f"WITH {SC} SELECT zone, model, count(*) FILTER (WHERE y > 100) AS n_spikes, {r('avg(abs(y - q50)) FILTER (WHERE y > 100)')} AS spike_mae, {r('avg(abs(y - q50))')} AS overall_mae FROM sc GROUP BY 1, 2",
    "backtest_table": f"WITH {SC} SELECT zone, model, valid_time, {named({'actual': 'y', 'q50': 'q50', 'q05': 'q05', 'q95': 'q95', 'error': 'q50 - y', 'abs_error': 'abs(q50 - y)'})} FROM sc WHERE {P50}",
    "backtest_kpis": f"""WITH {SC} SELECT zone, model, count(*) AS n_hours, count(*) FILTER (WHERE {P50}) AS n_forecast, {r(f'100 * avg(CASE WHEN {P50} THEN 1.0 ELSE 0.0 END)')} AS forecast_share,
 {r('avg(abs(q50 - y))')} AS mae, {r(f'100 * avg({HIT}) FILTER (WHERE {P50})')} AS coverage FROM sc GROUP BY 1, 2""",
    "stored_vs_live": f"""WITH {ONE}, {V[len(EV) + 2:]}, st AS (SELECT zone, valid_time, value AS q50 FROM ({LATEST % f"v WHERE series_id = 21 AND {GATE}"})),
 lv AS (SELECT zone, count(*) AS nw, avg(abs(q50 - y)) AS mae_live FROM one GROUP BY 1), ss AS (SELECT zone, count(q50) AS n_stored, avg(abs(price - q50)) AS mae_stored FROM st LEFT JOIN s USING (zone, valid_time) GROUP BY 1)
 SELECT zone, coalesce(n_stored, 0) AS n_stored, {r('100.0 * coalesce(n_stored, 0) / nw')} AS stored_share, {rr(['mae_stored', 'mae_live'])}, {r('mae_stored - mae_live')} AS delta_mae FROM lv LEFT JOIN ss USING (zone)""",
    "model_comparison": f"WITH {SC}, {HM}, u AS (" + " UNION ALL ".join(f"SELECT zone, model, '{m}' AS metric, {m} AS v FROM hm" for m in ("mae", "rmse", "mape", "coverage_q5_q95"))
    + ") SELECT zone, metric, " + ", ".join(f"{r(f'''max(v) FILTER (WHERE model = '{m}')''')} AS {m}" for m in MODELS) + " FROM u GROUP BY 1, 2",
    "period_breakdown": f"WITH {SC}, {HM} " + " UNION ALL ".join(f"SELECT zone, model, '{p}' AS period, {r(c)} AS mae FROM hm" for p, c in (("overall", "mae"), ("night", "night_mae"), ("peak", "peak_mae"))),
    "prefer_stored": f"""WITH {ONE}, {V[len(EV) + 2:]}, la AS ({LATEST % "v WHERE knowledge_time < TIMESTAMP '2023-12-29 02:00'"}),
 st AS (SELECT zone, valid_time, max(value) FILTER (WHERE series_id = 20) AS q05, max(value) FILTER (WHERE series_id = 21) AS q50, max(value) FILTER (WHERE series_id = 22) AS q95 FROM la GROUP BY 1, 2),
 hv AS (SELECT DISTINCT zone FROM st WHERE q50 IS NOT NULL)
 SELECT zone, valid_time, {rr(['q05', 'q50', 'q95'])}, 'stored' AS source FROM st WHERE zone IN (SELECT zone FROM hv)
 UNION ALL SELECT zone, valid_time, {rr(['q05', 'q50', 'q95'])}, 'live' AS source FROM one WHERE zone NOT IN (SELECT zone FROM hv)""",
    "crps": f"WITH {SC} SELECT zone, model, {named(EVAL)} FROM sc WHERE {P50} GROUP BY 1, 2",
    "reliability": f"WITH {SC}, rel AS (" + REL.format(keys="zone, model", src="sc") + f") SELECT zone, model, CAST(nominal AS DOUBLE) AS nominal, {r('observed')} AS observed FROM rel",
    "fold_metrics": f"WITH {FM} SELECT zone, fold, model, {rr(EVAL)} FROM fm",
    "fold_summary": f"WITH {FM} SELECT zone, model, " + ", ".join(f"{r(f'avg({m})')} AS {m}_mean, {r(f'stddev_samp({m})')} AS {m}_std" for m in EVAL) + " FROM fm GROUP BY 1, 2",
    "fold_reliability": f"WITH {FSC}, rel AS (" + REL.format(keys="zone, fold, model", src="fsc") + f") SELECT zone, model, CAST(nominal AS DOUBLE) AS nominal, {r('avg(observed)')} AS observed FROM rel GROUP BY 1, 2, 3",
    "walk_forward_folds": f"""WITH {D}, {FOLDS}, a AS (SELECT zone, fold, count(price) FILTER (WHERE valid_time >= train_start AND valid_time < train_end) AS n_train,
 count(price) FILTER (WHERE valid_time >= test_start AND valid_time < test_end) AS n_test FROM d, folds GROUP BY 1, 2)
 SELECT fold, zone, n_train, n_test, train_start, train_end, test_start, test_end FROM a JOIN folds USING (fold) WHERE n_train >= 24 AND n_test >= 24""",
    "conformal_fit": f"WITH {SC}, {CONF.format(cov='0.9')} SELECT zone, model, {r('correction')} AS correction, n_calibration, CAST(0.9 AS DOUBLE) AS target_coverage, {r('raw_coverage')} AS raw_coverage FROM cf",
    "conformal_apply": f"""WITH {SC}, {CONF.format(cov='0.97')} SELECT zone, valid_time, model, {r('y')} AS y, {r('q05 - greatest(coalesce(correction, 0), 0)')} AS q05, {r('q50')} AS q50,
 {r('q95 + greatest(coalesce(correction, 0), 0)')} AS q95 FROM sc LEFT JOIN cf USING (zone, model)""",
    "quantile_ordering": f"""WITH {PF} SELECT zone, valid_time, {r('CASE WHEN price_lag48h IS NOT NULL AND price_lag24h IS NOT NULL THEN least(price_lag48h, price_lag24h) END')} AS q05,
 {r('price_lag24h')} AS q50, {r('CASE WHEN price_lag72h IS NOT NULL AND price_lag24h IS NOT NULL THEN greatest(price_lag72h, price_lag24h) END')} AS q95 FROM pf""",
    "base_predictions": f"WITH {SC}, {BASE} SELECT zone, valid_time, " + rr([f"{m}_{q}" for m in ("lgbm", "xgb", "cat") for q in ("q05", "q50", "q95")]) + " FROM base",
    "ridge_stack": f"WITH {RIDGE} " + " UNION ALL ".join(f"SELECT zone, quantile, n, {rr(['intercept', 'w_lgbm', 'w_xgb', 'w_cat'], 5)} FROM r{q}" for q in ("q05", "q50", "q95")),
    "stack_predict": f"""WITH {RIDGE}, e AS (SELECT base.zone, valid_time, {ENS} FROM base LEFT JOIN rq05 ON base.zone = rq05.zone LEFT JOIN rq50 ON base.zone = rq50.zone LEFT JOIN rq95 ON base.zone = rq95.zone)
 SELECT zone, valid_time, {r('CASE WHEN eq05 IS NOT NULL AND eq50 IS NOT NULL THEN least(eq05, eq50) END', 5)} AS ens_q05, {r('eq50', 5)} AS ens_q50,
 {r('CASE WHEN eq95 IS NOT NULL AND eq50 IS NOT NULL THEN greatest(eq95, eq50) END', 5)} AS ens_q95 FROM e""",
    "recency_weights": f"""WITH {S}, a AS (SELECT zone, valid_time, price, pow(2.0, -(row_number() OVER (PARTITION BY zone ORDER BY valid_time DESC) - 1) / 240.0) AS w FROM s)
 SELECT zone, valid_time, {r('price', 8)} AS price, {r('w / avg(w) OVER (PARTITION BY zone)', 8)} AS weight FROM a""",
    "weighted_quantiles": f"""WITH {S}, a AS (SELECT zone, price, pow(2.0, -(row_number() OVER (PARTITION BY zone ORDER BY valid_time DESC) - 1) / 240.0) AS w FROM s),
 c AS (SELECT zone, price, sum(w) OVER (PARTITION BY zone ORDER BY price) AS upto, sum(w) OVER (PARTITION BY zone) AS total FROM a)
 SELECT zone, count(*) AS n, """ + ", ".join(f"{r(f'min(price) FILTER (WHERE upto >= {p} * total)')} AS {q}" for q, p in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95)))
    + f", {r('max(price)')} AS top FROM c GROUP BY 1",
    "train_val_split": f"""WITH {S}, a AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY valid_time DESC) AS k, count(*) OVER (PARTITION BY zone) AS n FROM s)
 SELECT zone, valid_time, {r('price')} AS price, k <= least(greatest(720, floor(n * 0.15)), n // 2) AS is_val FROM a""",
    "expanding_blocks": f"""WITH {S}, a AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY valid_time) - 1 AS k, count(*) OVER (PARTITION BY zone) AS n FROM s)
 SELECT zone, valid_time, {r('price')} AS price, CAST(CASE WHEN k < n - 3 * (n // 4) THEN 0 ELSE (k - (n - 3 * (n // 4))) // (n // 4) + 1 END AS BIGINT) AS cv_block FROM a""",
    "calendar_split": f"""WITH {S} SELECT zone, valid_time, {r('price')} AS price, CASE WHEN valid_time < TIMESTAMP '2024-01-18' THEN 'train' WHEN valid_time < TIMESTAMP '2024-01-26' THEN 'calibration'
 WHEN valid_time < TIMESTAMP '2024-01-30' THEN 'test' END AS split FROM s""",
    "label_coverage": f"WITH {D} SELECT zone, count(*) AS n_rows, count(price) AS n_labelled, count(price) >= 720 AS trainable FROM d GROUP BY 1",
    "promotion_history": f"""WITH {FM}, a AS (SELECT zone || '-' || model AS model_name, fold AS version, mae, min(round(mae, 4)) OVER (PARTITION BY zone, model ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS champion_mae FROM fm)
 SELECT model_name, version, {rr(['mae', 'champion_mae'])}, CASE WHEN champion_mae IS NULL OR mae < champion_mae THEN 'promoted' ELSE 'challenger' END AS action FROM a""",
    "run_delta": f"""WITH {FSC}, a AS (SELECT zone, model, fold, avg(abs(q50 - y)) AS mae, avg({HIT}) * 100 AS coverage_q5_q95 FROM fsc WHERE {P50} GROUP BY 1, 2, 3)
 SELECT zone, model, fold, {r('mae')} AS mae, {r('mae - lag(mae) OVER w')} AS mae_delta, {r('coverage_q5_q95')} AS coverage_q5_q95, {r('coverage_q5_q95 - lag(coverage_q5_q95) OVER w')} AS coverage_delta
 FROM a WINDOW w AS (PARTITION BY zone, model ORDER BY fold)""",
    "retrain_gate": f"""WITH {S}, a AS (SELECT zone, min(valid_time) + INTERVAL 23 DAY + INTERVAL 1 HOUR * length(zone) AS trained_at, max(valid_time) AS latest_price FROM s GROUP BY 1)
 SELECT zone, trained_at, latest_price, {r('epoch(latest_price - trained_at) / 86400.0')} AS gap_days, epoch(latest_price - trained_at) / 86400.0 < 7 AS skip FROM a""",
    "threshold_alerts": f"WITH {TAIL} SELECT zone, metric, {r('value', 4)} AS value, {r('threshold', 4)} AS threshold FROM alerts",
    "drift_report": f"""WITH {TAIL}, c AS (SELECT zone, count(*) AS k FROM alerts GROUP BY 1)
 SELECT al.zone, 7 AS window_days, 20 AS baseline_days, {", ".join(f"{r(f'round({n}, 4)', 4)} AS {n}" for n in [*POINT, 'naive_mae_eur', 'rmae', 'baseline_pinball_q50'])},
 n_hours, coalesce(k, 0) > 0 AS drift_detected, coalesce(k, 0) AS n_alerts, CAST(NULL AS VARCHAR) AS warning FROM al LEFT JOIN c USING (zone)""",
    "training_rows": f"""WITH {D}, {matrix('spine')}, m AS ({MATRIX_SELECT}) SELECT zone, valid_time, price, price_lag336h, temp_x_hour FROM m
 WHERE price IS NOT NULL AND temperature IS NOT NULL AND """ + " AND ".join(f"price_lag{h}h IS NOT NULL" for h in LAGS) + " AND price_roll24h IS NOT NULL AND price_roll168h IS NOT NULL",
    "boosted_leaves": f"""WITH {S}, k AS (SELECT *, hour(valid_time) >= 12 AS late, row_number() OVER (PARTITION BY zone, hour(valid_time) >= 12 ORDER BY price) AS i,
 count(*) OVER (PARTITION BY zone, hour(valid_time) >= 12) AS n FROM s),
 v AS (SELECT zone, late, """ + ", ".join(f"min(price) FILTER (WHERE i >= {q} * n * (1 - 1e-12)) AS q{int(q * 100):02d}" for q in (0.05, 0.5, 0.95)) + f""" FROM k GROUP BY 1, 2)
 SELECT zone, valid_time, {", ".join(f"{r(q)} AS lgbm_{q}" for q in ("q05", "q50", "q95"))} FROM k JOIN v USING (zone, late)""",
    # gradients of the base quantile, then the largest penalised gain at the root and again on either side of it
    "boosted_two_levels": f"""WITH {S}, k AS (SELECT *, hour(valid_time) // 6 AS f0, CAST(dayofweek(valid_time) IN (0, 6) AS INT) AS f1,
  row_number() OVER (PARTITION BY zone ORDER BY price) AS i, count(*) OVER (PARTITION BY zone) AS n FROM s),
 qs AS (SELECT unnest([0.05, 0.5, 0.95]::DOUBLE[]) AS q),
 ba AS (SELECT zone, q, min(price) FILTER (WHERE i >= q * n) AS base FROM k, qs GROUP BY 1, 2),
 x0 AS (SELECT zone, valid_time, price - base AS r, base, f0, f1, q, CASE WHEN price >= base THEN -q ELSE 1 - q END AS g, 0 AS node FROM k JOIN ba USING (zone)),
 {best_split('x0', 'b1')},
 x1 AS (SELECT x0.* REPLACE (CASE WHEN f IS NULL THEN -1 ELSE 1 + CAST(CASE f WHEN 0 THEN f0 ELSE f1 END > v AS INT) END AS node) FROM x0 LEFT JOIN b1 USING (zone, q, node)),
 {best_split('x1', 'b2')},
 x2 AS (SELECT x1.*, CASE WHEN f IS NULL THEN -1 ELSE CAST(CASE f WHEN 0 THEN f0 ELSE f1 END > v AS INT) END AS side FROM x1 LEFT JOIN b2 USING (zone, q, node)),
 x3 AS (SELECT *, row_number() OVER (PARTITION BY zone, q, node, side ORDER BY r) AS i, count(*) OVER (PARTITION BY zone, q, node, side) AS n FROM x2),
 le AS (SELECT zone, q, node, side, min(r) FILTER (WHERE i >= q * n) AS value FROM x3 GROUP BY 1, 2, 3, 4)
 SELECT zone, valid_time, """ + ", ".join(r(f"max(base + value) FILTER (WHERE q = {q}::DOUBLE)") + f" AS lgbm_q{int(q * 100):02d}" for q in (0.05, 0.5, 0.95)) + """
 FROM x3 JOIN le USING (zone, q, node, side) GROUP BY 1, 2""",
    "target_encoding": f"""WITH {S} SELECT zone, valid_time, {r('price')} AS price, hour(valid_time) AS hour,
 {r('avg(price) OVER (PARTITION BY zone, hour(valid_time) ORDER BY valid_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')} AS hour_target FROM s""",
    "walk_forward": f"""WITH {D}, {FOLDS}, tr AS (SELECT zone, fold, hour(valid_time) AS h, min(price) AS q05, avg(price) AS q50, max(price) AS q95
  FROM d JOIN folds ON valid_time >= train_start AND valid_time < train_end WHERE price IS NOT NULL GROUP BY 1, 2, 3),
 use AS (SELECT zone, fold FROM d, folds GROUP BY 1, 2 HAVING count(price) FILTER (WHERE valid_time >= train_start AND valid_time < train_end) >= 24
  AND count(price) FILTER (WHERE valid_time >= test_start AND valid_time < test_end) >= 24),
 te AS (SELECT d.zone, fold, 'seasonal' AS model, price AS y, q05, q50, q95 FROM d JOIN folds ON valid_time >= test_start AND valid_time < test_end
  JOIN use USING (zone, fold) LEFT JOIN tr ON tr.zone = d.zone AND tr.fold = folds.fold AND tr.h = hour(valid_time))
 SELECT zone, fold, model, {named(EVAL)} FROM te WHERE {P50} GROUP BY 1, 2, 3""",
    # one standardised feature: a soft threshold for each penalty, chosen on three expanding splits
    "walk_forward_lear": f"""WITH {PF}, {FOLDS}, x AS (SELECT zone, fold, hour(valid_time) AS h, valid_time, price_lag24h AS x, price AS y
  FROM pf JOIN folds ON valid_time >= train_start AND valid_time < train_end WHERE price IS NOT NULL AND price_lag24h IS NOT NULL),
 k AS (SELECT *, row_number() OVER (PARTITION BY zone, fold, h ORDER BY valid_time) AS k, count(*) OVER w AS n, avg(x) OVER w AS mx, stddev_pop(x) OVER w AS sd
  FROM x WINDOW w AS (PARTITION BY zone, fold, h)),
 z AS (SELECT *, (x - mx) / sd AS z, CASE WHEN k <= n - 3 * (n // 4) THEN 0 ELSE (k - 1 - (n - 3 * (n // 4))) // (n // 4) + 1 END AS b FROM k WHERE n >= 10),
 al AS (SELECT unnest([0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5]::DOUBLE[]) AS a),
 tr AS (SELECT zone, fold, h, s, count(*) AS m, avg(z) AS mz, avg(y) AS my, count(*) * var_pop(z) AS q, count(*) * covar_pop(z, y) AS c
  FROM z JOIN range(3) t(s) ON b <= s GROUP BY 1, 2, 3, 4),
 be AS (SELECT *, CASE WHEN q > 1e-12 * m THEN sign(c) * greatest(abs(c) - m * a, 0) / q ELSE 0 END AS beta FROM tr, al),
 er AS (SELECT zone, fold, h, a, s, avg(pow(y - my - beta * (z - mz), 2)) AS e FROM be JOIN z USING (zone, fold, h) WHERE b = s + 1 GROUP BY 1, 2, 3, 4, 5),
 ch AS (SELECT zone, fold, h, first(a ORDER BY e, a DESC) AS a FROM (SELECT zone, fold, h, a, sum(e) AS e FROM er GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
 fu AS (SELECT zone, fold, h, any_value(mx) AS mx, any_value(sd) AS sd, avg(y) AS my, any_value(a) AS a, covar_pop(z, y) AS c FROM z JOIN ch USING (zone, fold, h) GROUP BY 1, 2, 3),
 fi AS (SELECT zone, fold, h, sign(c) * greatest(abs(c) - a, 0) / sd AS coef, my - sign(c) * greatest(abs(c) - a, 0) / sd * mx AS b0 FROM fu),
 rs AS (SELECT zone, fold, h, quantile_cont(y - b0 - coef * x, 0.05) AS lo, quantile_cont(y - b0 - coef * x, 0.95) AS hi FROM x JOIN fi USING (zone, fold, h) GROUP BY 1, 2, 3),
 use AS (SELECT zone, fold FROM d, folds GROUP BY 1, 2 HAVING count(price) FILTER (WHERE valid_time >= train_start AND valid_time < train_end) >= 24
  AND count(price) FILTER (WHERE valid_time >= test_start AND valid_time < test_end) >= 24),
 ap AS (SELECT pf.zone, folds.fold, hour(valid_time) AS h, price AS y, price_lag24h AS x FROM pf JOIN folds ON valid_time >= test_start AND valid_time < test_end JOIN use USING (zone, fold)),
 te AS (SELECT ap.zone, ap.fold, 'lear' AS model, y, b0 + coef * x + lo AS q05, b0 + coef * x AS q50, b0 + coef * x + hi AS q95
  FROM ap JOIN fi USING (zone, fold, h) JOIN rs USING (zone, fold, h))
 SELECT zone, fold, model, {named(EVAL)} FROM te WHERE {P50} GROUP BY 1, 2, 3""",
    "normalize_prices": f"WITH {S} SELECT valid_time, {r('price')} AS value, zone FROM s",
    "normalize_load": f"WITH {EV} SELECT valid_time, {r('sum(value)')} AS actual_load, zone FROM ev GROUP BY valid_time, zone",
    "normalize_generation": f"WITH {FUEL} SELECT valid_time, {', '.join(f'{_q(n)} AS {chr(34)}{n}{chr(34)}' for n in FUELS.values())}, zone FROM fuel",
    "normalize_crossborder": f"WITH {RFLOW} SELECT valid_time, {r('value_mw')} AS value, from_zone, to_zone FROM rf",
    "normalize_weather": f"WITH {EV}, {WEATHER} " + " UNION ALL ".join(
        f"SELECT zone, '{b}' AS variable, valid_time, {r(a)} AS value FROM wx WHERE {a} IS NOT NULL"
        for a, b in (("temperature", "temperature_2m"), ("wind_speed", "wind_speed_10m"), ("irradiance", "shortwave_radiation"))),
    "weather_wide": f"""WITH {EV}, {WEATHER} SELECT valid_time, {r('temperature')} AS temperature_2m, {r('wind_speed')} AS wind_speed_10m,
 {r('irradiance')} AS shortwave_radiation, zone FROM wx WHERE temperature IS NOT NULL""",
    # Easter by the Meeus/Jones/Butcher steps
    "holiday_flags": """WITH t AS (SELECT DISTINCT o_orderdate AS valid_time, year(o_orderdate) AS y, month(o_orderdate) * 100 + day(o_orderdate) AS md, isodow(o_orderdate) AS wd FROM orders),
 p AS (SELECT *, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM t), q AS (SELECT *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 AS h FROM p),
 u AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS m FROM q), v AS (SELECT *, h + m - 7 * ((a + 11 * h + 22 * m) // 451) + 114 AS n FROM u),
 e AS (SELECT *, date_diff('day', make_date(y, n // 31, n % 31 + 1), CAST(valid_time AS DATE)) AS off FROM v)
 SELECT valid_time, CAST(CASE WHEN md IN (101, 106, 501, 1224, 1225, 1226, 1231) OR off IN (-2, 0, 1, 39, 49) OR (md = 606 AND y >= 2005) OR (off = 50 AND y <= 2004)
 OR (wd = 6 AND (md BETWEEN 620 AND 626 OR md BETWEEN 1031 AND 1106)) OR (wd = 5 AND md BETWEEN 619 AND 625) THEN 1 ELSE 0 END AS BIGINT) AS is_holiday FROM e""",
    "scan_window": f"WITH {EV} SELECT event_id, valid_time, {r('value')} AS value FROM ev WHERE zone = 'view' AND valid_time >= TIMESTAMP '2024-01-05' AND valid_time < TIMESTAMP '2024-01-06 12:00'",
    "explorer_window": f"""WITH {S} SELECT zone, {r('avg(price)')} AS mean, {r('max(price)')} AS max, {r('min(price)')} AS min, {r('stddev_samp(price)')} AS std FROM s
 WHERE valid_time >= TIMESTAMP '2024-01-05' AND valid_time < TIMESTAMP '2024-01-10' GROUP BY 1""",
    "naive_mae": f"""WITH {S}, a AS (SELECT zone, price AS y, lag(price, 24) OVER (PARTITION BY zone ORDER BY valid_time) AS naive FROM s)
 SELECT zone, {r('CASE WHEN count(naive) >= 2 THEN avg(abs(y - naive)) END')} AS naive_mae_eur FROM a GROUP BY 1""",
    "any_drift": f"WITH {TAIL} SELECT count(*) > 0 AS any_drift FROM alerts",
    "spike_hours": f"WITH {S} SELECT zone, valid_time, {r('price')} AS price FROM s WHERE price > 100",
}

_PRICE_VIEW = [f"price_lag{h}h" for h in LAGS] + ["price_roll24h_mean", "price_roll168h_mean", "price_roll168h_std", "price_roll720h_std"]
_GRID_VIEW = ["temperature_2m", "wind_speed_10m", "solar_radiation", "temp_x_wind", "temp_x_hour", "wind_mw", "solar_mw", "load_mw", "net_exchange_mw"]


def fresh(alias: str, cols, age: str) -> str:
    return ", ".join(f"CASE WHEN e.ts - {alias}.t <= INTERVAL {age} THEN {alias}.{c} END AS {c}" for c in cols)


ORACLE["feature_service"] = f"""WITH {EV}, fv AS ({ORACLE['feature_views']}), a AS (SELECT *, valid_time AS t FROM fv),
 g AS (SELECT *, valid_time + INTERVAL 90 MINUTE AS t FROM fv WHERE temperature_2m IS NOT NULL AND hour(valid_time) % 3 = 0)
 SELECT e.event_id, e.zone, e.ts AS valid_time, {r('e.value')} AS price, {fresh('p', _PRICE_VIEW, '30 DAY')},
 {fresh('c', calendar(), '30 MINUTE')}, {fresh('g', _GRID_VIEW, '4 HOUR')}
 FROM ev e ASOF LEFT JOIN a p ON e.zone = p.zone AND e.ts >= p.t ASOF LEFT JOIN a c ON e.zone = c.zone AND e.ts >= c.t
 ASOF LEFT JOIN g ON e.zone = g.zone AND e.ts >= g.t"""
