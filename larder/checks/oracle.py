"""DuckDB oracle SQL for the registered queries.

Each query is restated in plain SQL over the driver's tables, written the
direct way (dense grids, ROW_NUMBER tails, per-row weights) rather than the
way the Spark plans compute it, so that the comparison checks the
reformulations too.  Doubles are rounded half-even to 6 places on both
sides (``round_even`` here, ``rint`` scaling in Spark).
"""

from __future__ import annotations

from ..sources import derived as D


# Fixed values of the rules, written out here on their own: a wrong one in the library's
# configuration must show as a difference.
ACTIVITY_LOG_LIMIT = 200
BACKTEST_MIN_TRAIN = 21
BACKTEST_MIN_TRAIN_ROWS = 7
BACKTEST_TEST_DAYS = 14
CONFIDENCE_HIGH = 70
CONFIDENCE_MEDIUM = 40
CONFIDENCE_WEIGHTS = {"data": 0.3, "accuracy": 0.35, "stability": 0.2, "calibration": 0.15}
CORRECTION_MIN_POINTS = 3
CSV_MAX_QUANTITY = 999999
DEFAULT_WEIGHTS = {"dow": 0.33, "exp": 0.34, "gbt": 0.33}
DORMANT_ZERO_RATE = 0.95
DOW_DECAY = 0.95
DOW_RECENT_DAYS = 21
DOW_TREND_CLIP = (0.3, 3.0)
EXTENDED_WINDOWS = (60, 90)
HORIZON_DAYS = 14
INTERMITTENT_ZERO_RATE = 0.65
LINE_STATUSES = ("pending", "picked", "shorted", "loaded", "delivered")
MIN_DATA_POINTS_HIGH = 5
MIN_ORDER_DAYS = 3
RECENCY_HALF_LIFE = 30
ROUTING_WINDOW = 28
SAFETY_MULTIPLIER = 1.15
SAFETY_VOLATILE_CV = 1.0
SAFETY_VOLATILE_EXTRA = 0.1
SPORADIC_MIN_ORDER_FREQ = 0.05
TIER_HIGH_MIN = 5.0
TIER_LOW_MIN = 0.5
USAGE_WINDOW_LONG = 60
USAGE_WINDOW_SHORT = 30
V1_TREND_DAYS = 20
WEIGHTED_DECAY = 0.9


def r6(x: str) -> str:
    return f"round_even({x}, 6)"


# --------------------------------------------------------------------------
# shared CTE fragments
# --------------------------------------------------------------------------

def lines_sql(kind: str = "type") -> str:
    if kind == "events":
        return ("SELECT event_type AS store, CAST(user_id AS VARCHAR) AS product, "
                "CAST(ts AS DATE) AS date, value AS qty FROM events")
    pcol = {"type": "p_type", "brand": "p_brand"}[kind]
    return (f"SELECT r.r_name AS store, p.{pcol} AS product, CAST(l.l_shipdate AS DATE) AS date, "
            "l.l_quantity AS qty FROM lineitem l "
            "JOIN part p ON l.l_partkey = p.p_partkey "
            "JOIN supplier s ON l.l_suppkey = s.s_suppkey "
            "JOIN nation n ON s.s_nationkey = n.n_nationkey "
            "JOIN region r ON n.n_regionkey = r.r_regionkey")


def demand_ctes(kind: str = "type") -> str:
    """lines, daily, bounds, dense (with days_ago and Monday-0 weekday)."""
    return f"""
lines AS ({lines_sql(kind)}),
daily AS (SELECT store, product, date, SUM(qty) AS qty FROM lines GROUP BY store, product, date),
bounds AS (SELECT MIN(date) AS d0, MAX(date) AS d1 FROM daily),
grid AS (
  SELECT p.store, p.product,
         CAST(unnest(generate_series(b.d0, b.d1, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT DISTINCT store, product FROM daily) p CROSS JOIN bounds b),
dense AS (
  SELECT g.store, g.product, g.date, COALESCE(d.qty, 0.0) AS qty,
         datediff('day', g.date, (SELECT d1 FROM bounds)) AS days_ago,
         isodow(g.date) - 1 AS dow
  FROM grid g LEFT JOIN daily d
    ON d.store = g.store AND d.product = g.product AND d.date = g.date)"""


def lane_ctes() -> str:
    """tails (literal tail-n counts per series) and lanes (chosen window + lane)."""
    w0, w1, w2 = ROUTING_WINDOW, *EXTENDED_WINDOWS
    m = MIN_ORDER_DAYS

    def tail(n: str) -> str:
        return (f"COUNT(*) FILTER (WHERE rn <= {n}) AS n_{n}, "
                f"COUNT(*) FILTER (WHERE rn <= {n} AND qty > 0) AS c_{n}, "
                f"COALESCE(SUM(qty) FILTER (WHERE rn <= {n}), 0) AS s_{n}, "
                f"COALESCE(SUM(qty) FILTER (WHERE rn <= {n} AND qty > 0), 0) AS p_{n}")

    def pick(col: str) -> str:
        return (f"CASE w WHEN {w0} THEN {col}_{w0} WHEN {w1} THEN {col}_{w1} "
                f"WHEN {w2} THEN {col}_{w2} ELSE {col}_all END")

    return f"""
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY store, product ORDER BY date DESC) AS rn
           FROM dense),
tails AS (
  SELECT store, product, COUNT(*) AS series_days, {tail(str(w0))}, {tail(str(w1))}, {tail(str(w2))},
         COUNT(*) AS n_all, COUNT(*) FILTER (WHERE qty > 0) AS c_all,
         SUM(qty) AS s_all, COALESCE(SUM(qty) FILTER (WHERE qty > 0), 0) AS p_all
  FROM ranked GROUP BY store, product),
picked AS (
  SELECT *, CASE WHEN c_{w0} >= {m} THEN {w0} WHEN c_{w1} >= {m} THEN {w1}
                 WHEN c_{w2} >= {m} THEN {w2} WHEN c_all >= {m} THEN -1 ELSE {w0} END AS w
  FROM tails),
lanes AS (
  SELECT store, product, series_days,
         CAST(CASE WHEN w = -1 THEN series_days ELSE w END AS BIGINT) AS window_days,
         CAST({pick('n')} AS BIGINT) AS n_days,
         CAST({pick('c')} AS BIGINT) AS n_order_days,
         {pick('s')} AS window_qty, {pick('p')} AS window_nonzero_qty
  FROM picked),
lanes2 AS (
  SELECT *,
    CASE WHEN n_days > 0 THEN 1.0 - n_order_days / n_days END AS zero_rate,
    CASE WHEN n_days = 0 OR window_qty = 0 THEN 'dormant'
         WHEN 1.0 - n_order_days / n_days >= {DORMANT_ZERO_RATE} THEN 'dormant'
         WHEN 1.0 - n_order_days / n_days >= {INTERMITTENT_ZERO_RATE} THEN 'intermittent'
         ELSE 'daily' END AS lane,
    CASE WHEN n_order_days = 0 THEN 0.0
         ELSE GREATEST(0.0, (n_order_days / n_days) * (window_nonzero_qty / n_order_days)) END
      AS intermittent_rate
  FROM lanes)"""


def dow_ctes(days: int | str = HORIZON_DAYS) -> str:
    """prof2 / prof1 (per weekday) and trend2 / trend1 (per series) on dense."""
    d = DOW_DECAY
    return f"""
prof2 AS (SELECT store, product, dow,
                 SUM(qty * POW({d}, days_ago)) / SUM(POW({d}, days_ago)) AS dow_avg
          FROM dense GROUP BY store, product, dow),
prof1 AS (SELECT store, product, dow, AVG(qty) AS dow_avg FROM dense GROUP BY store, product, dow),
trend AS (
  SELECT store, product, SUM(qty) AS tot,
    CASE WHEN AVG(qty) > 0 THEN LEAST(GREATEST(
          AVG(qty) FILTER (WHERE days_ago <= {DOW_RECENT_DAYS}) / AVG(qty), {DOW_TREND_CLIP[0]}),
          {DOW_TREND_CLIP[1]}) ELSE 1.0 END AS trend2,
    CASE WHEN AVG(qty) > 0 THEN LEAST(GREATEST(
          AVG(qty) FILTER (WHERE days_ago < {V1_TREND_DAYS}) / AVG(qty), {DOW_TREND_CLIP[0]}),
          {DOW_TREND_CLIP[1]}) ELSE 1.0 END AS trend1
  FROM dense GROUP BY store, product),
horizon AS (
  SELECT p.store, p.product,
         CAST(unnest(generate_series(b.d1 + 1, b.d1 + CAST({days} AS INTEGER), INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT DISTINCT store, product FROM daily) p CROSS JOIN bounds b),
horizon2 AS (
  SELECT h.*, CAST(datediff('day', (SELECT d1 FROM bounds), h.date) - 1 AS BIGINT) AS day_idx,
         isodow(h.date) - 1 AS dow FROM horizon h)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts) + "\n"


# --------------------------------------------------------------------------
# queries
# --------------------------------------------------------------------------

def q_daily_demand_dense() -> str:
    return with_(demand_ctes("type")) + f"""
SELECT store, product, date, {r6('qty')} AS qty FROM dense"""


def q_data_profile() -> str:
    return with_(f"lines AS ({lines_sql('type')})") + """
SELECT MIN(date) AS first_date, MAX(date) AS last_date, COUNT(DISTINCT store) AS n_stores,
       COUNT(DISTINCT product) AS n_products, COUNT(*) AS n_rows FROM lines"""


def q_sales_distinct() -> str:
    return with_(f"lines AS ({lines_sql('brand')})") + f"""
SELECT store, product, COUNT(*) AS n_rows, {r6('SUM(qty)')} AS qty
FROM (SELECT DISTINCT store, product, date, qty FROM lines) GROUP BY store, product"""


def q_lane_classify(kind: str = "brand") -> str:
    return with_(demand_ctes(kind), lane_ctes()) + f"""
SELECT store, product, window_days, n_days, n_order_days, {r6('zero_rate')} AS zero_rate, lane,
       {r6("CASE lane WHEN 'intermittent' THEN intermittent_rate ELSE 0.0 END")} AS lane_rate
FROM lanes2"""


def q_dow_forecast(version: int, kind: str = "type") -> str:
    prof, trend = ("prof2", "trend2") if version == 2 else ("prof1", "trend1")
    pred = f"COALESCE(p.dow_avg, 0.0) * t.{trend}"
    if version == 2:
        pred = f"GREATEST(0.0, {pred})"
    return with_(demand_ctes(kind), dow_ctes()) + f"""
SELECT h.store, h.product, h.day_idx, h.date,
       {r6(f'CASE WHEN t.tot = 0 THEN 0.0 ELSE {pred} END')} AS pred
FROM horizon2 h JOIN trend t ON h.store = t.store AND h.product = t.product
LEFT JOIN {prof} p ON p.store = h.store AND p.product = h.product AND p.dow = h.dow"""


def q_dow_profile(version: int, kind: str = "brand") -> str:
    prof, trend = ("prof2", "trend2") if version == 2 else ("prof1", "trend1")
    return with_(demand_ctes(kind), dow_ctes()) + f"""
SELECT p.store, p.product, CAST(p.dow AS BIGINT) AS dow,
       {r6('CASE WHEN t.tot = 0 THEN 0.0 ELSE p.dow_avg END')} AS dow_avg,
       {r6(f'CASE WHEN t.tot = 0 THEN 1.0 ELSE t.{trend} END')} AS trend
FROM {prof} p JOIN trend t ON p.store = t.store AND p.product = t.product"""


def q_lane_forecast(kind: str = "brand") -> str:
    return with_(demand_ctes(kind), lane_ctes(), dow_ctes()) + f"""
SELECT h.store, h.product, l.lane, h.day_idx, h.date,
       {r6("CASE WHEN l.lane = 'daily' THEN (CASE WHEN t.tot = 0 THEN 0.0 ELSE GREATEST(0.0, COALESCE(p.dow_avg, 0.0) * t.trend2) END) WHEN l.lane = 'intermittent' THEN l.intermittent_rate ELSE 0.0 END")} AS pred
FROM horizon2 h JOIN lanes2 l ON h.store = l.store AND h.product = l.product
JOIN trend t ON h.store = t.store AND h.product = t.product
LEFT JOIN prof2 p ON p.store = h.store AND p.product = h.product AND p.dow = h.dow"""


def oracle_sql() -> dict[str, str]:
    return {
        "daily_demand_dense": q_daily_demand_dense(),
        "data_profile": q_data_profile(),
        "sales_distinct": q_sales_distinct(),
        "lane_classify": q_lane_classify("brand"),
        "lane_classify_events": q_lane_classify("events"),
        "lane_forecast": q_lane_forecast("brand"),
        "dow_forecast_v2": q_dow_forecast(2, "type"),
        "dow_forecast_v1": q_dow_forecast(1, "type"),
        "dow_profile_v2": q_dow_profile(2, "brand"),
        "dow_profile_v1": q_dow_profile(1, "brand"),
        **{k: f() for k, f in FEATURE_SQL.items()},
        **{k: f() for k, f in APP_SQL.items()},
        **{k: f() for k, f in PACKING_SQL.items()},
        **{k: f() for k, f in BACKTEST_SQL.items()},
        **{k: f() for k, f in FEEDBACK_SQL.items()},
        **{k: f() for k, f in REPORT_SQL.items()},
        **{k: f() for k, f in IMPORT_SQL.items()},
        **{k: f() for k, f in EXTRA_SQL.items()},
    }


# --------------------------------------------------------------------------
# features
# --------------------------------------------------------------------------

_W = "PARTITION BY store, product ORDER BY date"


def _prev(n) -> str:
    return f"OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


_PAST = f"OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def q_feature_calendar() -> str:
    return with_(demand_ctes("type")) + f"""
SELECT store, product, date, CAST(isodow(date) - 1 AS BIGINT) AS dow,
  CAST(dayofmonth(date) AS BIGINT) AS day_of_month, CAST(weekofyear(date) AS BIGINT) AS week_of_year,
  CAST(month(date) AS BIGINT) AS month,
  CAST(CASE WHEN isodow(date) - 1 >= 5 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
  CAST(CASE WHEN isodow(date) - 1 = 0 THEN 1 ELSE 0 END AS BIGINT) AS is_monday,
  CAST(CASE WHEN isodow(date) - 1 = 4 THEN 1 ELSE 0 END AS BIGINT) AS is_friday,
  {r6('sin(2 * pi() * (isodow(date) - 1) / 7)')} AS dow_sin,
  {r6('cos(2 * pi() * (isodow(date) - 1) / 7)')} AS dow_cos,
  {r6('sin(2 * pi() * dayofmonth(date) / 31)')} AS dom_sin,
  {r6('cos(2 * pi() * dayofmonth(date) / 31)')} AS dom_cos
FROM dense"""


def q_feature_lags() -> str:
    cols = [f"{r6(f'LAG(qty, {k}) OVER ({_W})')} AS lag_{k}" for k in (1, 7, 14)]
    for n in (7, 14, 28):
        cols.append(f"{r6(f'AVG(qty) {_prev(n)}')} AS rolling_mean_{n}")
        cols.append(f"{r6(f'STDDEV_SAMP(qty) {_prev(n)}')} AS rolling_std_{n}")
    cols.append(f"{r6(f'MAX(qty) {_prev(7)}')} AS rolling_max_7")
    return with_(demand_ctes("type")) + f"""
SELECT store, product, date, {r6('qty')} AS qty, {', '.join(cols)} FROM dense"""


def q_feature_recency() -> str:
    return with_(demand_ctes("type")) + f"""
, f AS (SELECT store, product, date,
    COALESCE(LAST_VALUE(CASE WHEN qty <> 0 THEN qty END IGNORE NULLS) {_PAST}, 0.0) AS last_order_qty,
    AVG(qty) {_prev(7)} AS rm7, AVG(qty) {_prev(28)} AS rm28,
    COALESCE(datediff('day', MAX(CASE WHEN qty > 0 THEN date END) {_PAST}, date), 0) AS dsl
  FROM dense)
SELECT store, product, date, {r6('last_order_qty')} AS last_order_qty,
  {r6('LEAST(GREATEST(COALESCE(rm7 / NULLIF(rm28, 0), 1.0), 0.2), 5.0)')} AS trend_7_28,
  CAST(dsl AS BIGINT) AS days_since_last_order
FROM f"""


def _tier(x: str) -> str:
    return (f"CASE WHEN {x} >= {TIER_HIGH_MIN} THEN 'high' WHEN {x} >= {TIER_LOW_MIN} "
            "THEN 'low' ELSE 'sporadic' END")


def q_feature_product(kind: str = "brand") -> str:
    return with_(demand_ctes(kind)) + f"""
, s AS (SELECT store, product, AVG(qty) AS a, COALESCE(STDDEV_SAMP(qty), 0) AS sd,
               AVG(CASE WHEN qty > 0 THEN 1.0 ELSE 0.0 END) AS f
        FROM dense GROUP BY store, product)
SELECT store, product, {r6('a')} AS product_hist_avg,
  {r6('LEAST(GREATEST(COALESCE(sd / NULLIF(a, 0), 0.0), 0.0), 10.0)')} AS product_cv,
  {r6('f')} AS order_frequency, {_tier('a')} AS volume_tier
FROM s"""


def q_future_features(kind: str = "brand") -> str:
    return with_(demand_ctes(kind)) + f"""
, rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY store, product ORDER BY date DESC) AS rn,
                 COUNT(*) OVER (PARTITION BY store, product) AS n FROM dense),
t AS (SELECT store, product, SUM(qty) AS tot, AVG(qty) AS ha, STDDEV_SAMP(qty) AS hs,
        AVG(CASE WHEN qty > 0 THEN 1.0 ELSE 0.0 END) AS ofq,
        MAX(CASE WHEN rn = 1 THEN qty END) AS lag_1,
        MAX(CASE WHEN rn = LEAST(7, n) THEN qty END) AS lag_7,
        MAX(CASE WHEN rn = LEAST(14, n) THEN qty END) AS lag_14,
        AVG(qty) FILTER (WHERE rn <= 7) AS rm7, AVG(qty) FILTER (WHERE rn <= 14) AS rm14,
        AVG(qty) FILTER (WHERE rn <= 28) AS rm28,
        COALESCE(STDDEV_SAMP(qty) FILTER (WHERE rn <= 7), 0) AS rs7,
        COALESCE(STDDEV_SAMP(qty) FILTER (WHERE rn <= 14), 0) AS rs14,
        MAX(qty) FILTER (WHERE rn <= 7) AS rmax7,
        COALESCE(MAX(date) FILTER (WHERE qty > 0), MIN(date)) AS lod,
        COALESCE(arg_max(qty, date) FILTER (WHERE qty > 0), 0.0) AS loq
      FROM rk GROUP BY store, product HAVING SUM(qty) <> 0),
h AS (SELECT t.*, CAST(unnest(generate_series(b.d1 + 1, b.d1 + {HORIZON_DAYS}, INTERVAL 1 DAY)) AS DATE) AS date
      FROM t CROSS JOIN bounds b)
SELECT store, product, CAST(datediff('day', (SELECT d1 FROM bounds), date) - 1 AS BIGINT) AS day_idx, date,
  CAST(isodow(date) - 1 AS BIGINT) AS dow, CAST(dayofmonth(date) AS BIGINT) AS day_of_month,
  CAST(CASE WHEN isodow(date) - 1 >= 5 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
  CAST(CASE WHEN isodow(date) - 1 = 0 THEN 1 ELSE 0 END AS BIGINT) AS is_monday,
  CAST(CASE WHEN isodow(date) - 1 = 4 THEN 1 ELSE 0 END AS BIGINT) AS is_friday,
  {r6('sin(2 * pi() * (isodow(date) - 1) / 7)')} AS dow_sin,
  {r6('cos(2 * pi() * (isodow(date) - 1) / 7)')} AS dow_cos,
  {r6('sin(2 * pi() * dayofmonth(date) / 31)')} AS dom_sin,
  {r6('cos(2 * pi() * dayofmonth(date) / 31)')} AS dom_cos,
  {r6('lag_1')} AS lag_1, {r6('lag_7')} AS lag_7, {r6('lag_14')} AS lag_14,
  {r6('rm7')} AS rolling_mean_7, {r6('rm14')} AS rolling_mean_14, {r6('rm28')} AS rolling_mean_28,
  {r6('rs7')} AS rolling_std_7, {r6('rs14')} AS rolling_std_14, {r6('rmax7')} AS rolling_max_7,
  {r6('loq')} AS last_order_qty,
  {r6('LEAST(GREATEST(CASE WHEN rm28 > 0 THEN rm7 / rm28 ELSE 1.0 END, 0.2), 5.0)')} AS trend_7_28,
  CAST(datediff('day', lod, date) AS BIGINT) AS days_since_last_order,
  {r6('ha')} AS product_hist_avg,
  {r6('LEAST(GREATEST(CASE WHEN ha > 0 THEN COALESCE(hs, 0) / ha ELSE 0.0 END, 0.0), 10.0)')} AS product_cv,
  {r6('ofq')} AS order_frequency
FROM h"""


def q_recency_weights(kind: str = "brand") -> str:
    """Weights over the complete-feature rows of each store (lag_14 known)."""
    k = f"ln(2) / {RECENCY_HALF_LIFE}"
    return with_(demand_ctes(kind)) + f"""
, rows AS (SELECT store, product, date FROM (
     SELECT *, LAG(qty, 14) OVER ({_W}) AS l14 FROM dense) WHERE l14 IS NOT NULL),
m AS (SELECT store, MAX(date) AS last FROM rows GROUP BY store),
w AS (SELECT r.*, exp(-{k} * datediff('day', r.date, m.last)) AS w FROM rows r JOIN m USING (store))
SELECT store, product, date,
  {r6('w * COUNT(*) OVER (PARTITION BY store) / SUM(w) OVER (PARTITION BY store)')} AS weight
FROM w"""


FEATURE_SQL = {
    "feature_calendar": q_feature_calendar,
    "feature_lags": q_feature_lags,
    "feature_recency": q_feature_recency,
    "feature_product": q_feature_product,
    "future_features": q_future_features,
    "recency_weights": q_recency_weights,
}


# --------------------------------------------------------------------------
# replenishment app (events-derived tables)
# --------------------------------------------------------------------------

AS_OF = f"DATE '{D.APP_AS_OF.isoformat()}'"


def app_table_ctes() -> str:
    cats = ", ".join(f"'{c}'" for c in D.ITEM_CATEGORIES)
    return f"""
ev AS (SELECT event_type AS store_id, user_id AS item_id, CAST(ts AS DATE) AS d,
              hour(ts) AS hr, value FROM events),
usage AS (SELECT store_id, item_id, d AS usage_date,
                 CAST(SUM(floor(value / {D.UNIT_DIVISOR})) AS DOUBLE) AS quantity_used
          FROM ev WHERE hr < 12 GROUP BY store_id, item_id, d),
orders AS (SELECT store_id, item_id, d AS order_date,
                  CAST(SUM(floor(value / {D.UNIT_DIVISOR})) AS DOUBLE) AS quantity_ordered
           FROM ev WHERE hr >= 12 GROUP BY store_id, item_id, d),
snaps AS (SELECT store_id, item_id, d AS snapshot_date,
                 CAST(SUM(floor(value / {D.SNAPSHOT_DIVISOR})) AS DOUBLE) AS quantity_on_hand
          FROM ev WHERE isodow(d) = 7 GROUP BY store_id, item_id, d),
items AS (SELECT user_id AS id, 'Item ' || CAST(user_id AS VARCHAR) AS item_name,
                 'SKU-' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS sku,
                 [{cats}][user_id % {len(D.ITEM_CATEGORIES)} + 1] AS category,
                 CAST(user_id % 6 + 1 AS INTEGER) AS case_pack_quantity
          FROM (SELECT DISTINCT user_id FROM events)),
settings AS (SELECT store_id, item_id, CAST((item_id % 5) * 4 AS DOUBLE) AS par_level,
                    CAST(item_id % 3 AS DOUBLE) AS safety_stock,
                    CAST((item_id % 4) * 2 AS DOUBLE) AS min_send_quantity,
                    ['round_up_case_pack', 'round_up_integer', 'none'][item_id % 3 + 1] AS rounding_rule,
                    CASE WHEN item_id % 7 = 0 THEN 14 END AS usage_window_days,
                    item_id % 11 <> 0 AS active
             FROM (SELECT DISTINCT store_id, item_id FROM ev))"""


def overlay_cte(lo_days: int | None = None) -> str:
    lo_u = f" AND usage_date >= {AS_OF} - {lo_days}" if lo_days else ""
    lo_o = f" AND order_date >= {AS_OF} - {lo_days}" if lo_days else ""
    return f"""
ov AS (SELECT COALESCE(o.store_id, u.store_id) AS store_id, COALESCE(o.item_id, u.item_id) AS item_id,
              COALESCE(o.order_date, u.usage_date) AS date,
              COALESCE(o.quantity_ordered, u.quantity_used) AS qty,
              u.usage_date IS NOT NULL AS has_usage, o.order_date IS NOT NULL AS has_order
       FROM (SELECT * FROM usage WHERE usage_date < {AS_OF}{lo_u}) u
       FULL OUTER JOIN (SELECT * FROM orders WHERE order_date < {AS_OF}{lo_o}) o
         ON u.store_id = o.store_id AND u.item_id = o.item_id AND u.usage_date = o.order_date)"""


def app_stat_ctes(decay: float = WEIGHTED_DECAY, m: float = 0.0) -> str:
    same = f"isodow(ov.date) = isodow({AS_OF})"
    w = f"POW({decay}, datediff('day', ov.date, {AS_OF}) - 1)"
    if m > 0:
        w = f"{w} * CASE WHEN {same} THEN {1.0 + m} ELSE 1.0 END"

    def win(tag: str, col: str) -> str:
        f = f"FILTER (WHERE ago <= {col})"
        dm = (f"COUNT(date) FILTER (WHERE ago <= {col} AND same_dow)" if m > 0 else "0")
        return (f"COUNT(date) {f} AS n_{tag}, SUM(qty) {f} AS sum_{tag}, SUM(qty * w) {f} AS wq_{tag}, "
                f"SUM(w) {f} AS w_{tag}, CAST({dm} AS BIGINT) AS dowm_{tag}, "
                f"COALESCE(BOOL_OR(has_order) {f}, false) AS ord_{tag}, "
                f"COALESCE(BOOL_OR(has_usage) {f}, false) AS use_{tag}")

    def derived(tag: str) -> str:
        return (f"CASE WHEN n_{tag} > 0 THEN sum_{tag} / n_{tag} ELSE 0.0 END AS avg_{tag}, "
                f"CASE WHEN n_{tag} > 0 AND w_{tag} <> 0 THEN wq_{tag} / w_{tag} ELSE 0.0 END AS wavg_{tag}, "
                f"CASE WHEN n_{tag} = 0 THEN 'none' WHEN ord_{tag} AND use_{tag} THEN 'blended' "
                f"WHEN ord_{tag} THEN 'actual_orders' ELSE 'daily_usage' END AS src_{tag}")

    r = ROUTING_WINDOW
    return f"""
sw AS (SELECT s.*, i.item_name, i.case_pack_quantity,
              CASE WHEN s.usage_window_days > 0 THEN s.usage_window_days ELSE {USAGE_WINDOW_SHORT} END AS ws,
              CASE WHEN s.usage_window_days > 0 THEN GREATEST(2 * s.usage_window_days, {USAGE_WINDOW_LONG})
                   ELSE {USAGE_WINDOW_LONG} END AS wl
       FROM settings s LEFT JOIN items i ON i.id = s.item_id WHERE s.active),
j AS (SELECT sw.store_id, sw.item_id, sw.ws, sw.wl, ov.date, ov.qty, ov.has_usage, ov.has_order,
             datediff('day', ov.date, {AS_OF}) AS ago, {same} AS same_dow, {w} AS w
      FROM sw LEFT JOIN ov ON ov.store_id = sw.store_id AND ov.item_id = sw.item_id),
st AS (SELECT store_id, item_id, {win('s', 'ws')}, {win('l', 'wl')},
              COUNT(date) FILTER (WHERE ago <= {r}) AS r_n,
              COUNT(date) FILTER (WHERE ago <= {r} AND qty > 0) AS r_no,
              SUM(qty) FILTER (WHERE ago <= {r}) AS r_sum,
              SUM(qty) FILTER (WHERE ago <= {r} AND qty > 0) AS r_nz,
              STDDEV_SAMP(qty) FILTER (WHERE ago <= {r} AND qty > 0) AS r_sd
       FROM j GROUP BY store_id, item_id),
s2 AS (SELECT st.*, sw.par_level, sw.safety_stock, sw.min_send_quantity, sw.rounding_rule,
              sw.case_pack_quantity, sw.item_name, sw.ws, sw.wl, {derived('s')}, {derived('l')},
              CASE WHEN r_n > 0 THEN 1.0 - r_no / r_n ELSE 1.0 END AS zr,
              CASE WHEN r_n > 0 THEN r_sum / r_n ELSE 0.0 END AS r_avg,
              CASE WHEN r_no > 0 THEN r_nz / r_no ELSE 0.0 END AS anz,
              CASE WHEN r_no > 1 AND r_nz / r_no > 0 THEN r_sd / (r_nz / r_no) ELSE 0.0 END AS r_cv
       FROM st JOIN sw USING (store_id, item_id))"""


def app_forecast_ctes(weighted: bool = False, m: float = 0.0, override: str = "",
                      periodic: str = "false") -> str:
    """``override``: WHEN branches that fix a lane; ``periodic``: condition on the item."""
    a = "wavg" if weighted else "avg"
    method = "historical_weighted_v1" if weighted else "historical_simple_v1"
    k = MIN_DATA_POINTS_HIGH
    r = ROUTING_WINDOW
    conf = "dconf"
    extra = ""
    if weighted:
        extra += f""",
s4b AS (SELECT *, dconf = 'high' AND dcov > 0 AND dcov < 0.5 AS low_cov FROM s4),
s4c AS (SELECT *, CASE WHEN low_cov THEN 'medium' ELSE dconf END AS dconf_b FROM s4b),
s4d AS (SELECT *, {('dwin > 0 AND ddowm < GREATEST(1, dwin // 7) AND dconf_b = ' + chr(39) + 'high' + chr(39)) if m > 0 else 'false'} AS sparse_dow FROM s4c),
s5 AS (SELECT *, CASE WHEN sparse_dow THEN 'medium' ELSE dconf_b END AS dconf2 FROM s4d)"""
    else:
        extra += """,
s5 AS (SELECT *, false AS low_cov, false AS sparse_dow, dconf AS dconf2 FROM s4)"""
    return f"""
s3 AS (SELECT *,
         CASE {override} WHEN r_n = 0 THEN 'dormant' WHEN zr >= 0.95 THEN 'dormant'
              WHEN zr >= 0.65 THEN 'intermittent' WHEN {periodic} THEN 'periodic'
              ELSE 'daily' END AS lane,
         CASE WHEN n_s >= {k} THEN 'S' WHEN n_l >= {k} THEN 'L'
              WHEN n_s > 0 OR n_l > 0 THEN (CASE WHEN n_l > n_s THEN 'l' ELSE 's' END)
              ELSE 'N' END AS pick
       FROM s2),
s4 AS (SELECT *,
         CASE pick WHEN 'S' THEN 'high' WHEN 'L' THEN 'medium' ELSE 'low' END AS {conf},
         CASE WHEN pick = 'N' THEN 0.0 WHEN pick IN ('L', 'l') THEN {a}_l ELSE {a}_s END AS davg,
         CASE WHEN pick = 'N' THEN 0 WHEN pick IN ('L', 'l') THEN wl ELSE ws END AS dwin,
         CASE WHEN pick = 'N' THEN 0 WHEN pick IN ('L', 'l') THEN n_l ELSE n_s END AS dpts,
         CASE WHEN pick = 'N' THEN 'none' WHEN pick IN ('L', 'l') THEN src_l ELSE src_s END AS dsrc,
         CASE WHEN pick = 'N' THEN 0 WHEN pick IN ('L', 'l') THEN dowm_l ELSE dowm_s END AS ddowm,
         CASE WHEN (CASE WHEN pick = 'N' THEN 0 WHEN pick IN ('L', 'l') THEN wl ELSE ws END) <= 0 THEN 0.0
              ELSE LEAST((CASE WHEN pick = 'N' THEN 0 WHEN pick IN ('L', 'l') THEN n_l ELSE n_s END)
                         / (CASE WHEN pick = 'N' THEN 0 WHEN pick IN ('L', 'l') THEN wl ELSE ws END), 1.0)
              END AS dcov
       FROM s3){extra},
fc AS (SELECT *,
         CASE lane WHEN 'dormant' THEN 0.0
                   WHEN 'intermittent' THEN (CASE WHEN r_no = 0 THEN 0.0 ELSE round_even((r_no / r_n) * anz, 4) END)
                   WHEN 'periodic' THEN (CASE WHEN r_no = 0 THEN 0.0
                     ELSE round_even(anz / GREATEST(r_n / r_no, 3.0), 4) END)
                   ELSE davg END AS avg0,
         CAST(CASE WHEN lane = 'daily' THEN dwin ELSE {r} END AS BIGINT) AS window_days,
         CAST(CASE WHEN lane = 'daily' THEN dpts WHEN lane = 'dormant' THEN r_n ELSE r_no END AS BIGINT) AS data_points,
         CASE WHEN lane = 'daily' THEN dsrc WHEN r_no > 0 THEN 'actual_orders' ELSE 'none' END AS data_source,
         CASE lane WHEN 'dormant' THEN 'dormant_v1' WHEN 'intermittent' THEN 'intermittent_v1'
                   WHEN 'periodic' THEN 'periodic_v1' ELSE '{method}' END AS forecast_method,
         CASE WHEN lane = 'daily' THEN dconf2 WHEN lane = 'dormant' THEN 'low'
              WHEN r_no < CASE lane WHEN 'periodic' THEN 4 ELSE 3 END THEN 'low'
              ELSE 'medium' END AS conf0,
         ((lane = 'intermittent' AND r_no < 3) OR (lane = 'periodic' AND r_no < 4)) AS lane_low
       FROM s5),
oh AS (SELECT store_id, item_id, arg_max(quantity_on_hand, snapshot_date) AS oh_qty,
              MAX(snapshot_date) AS ohd
       FROM snaps WHERE snapshot_date <= {AS_OF} GROUP BY store_id, item_id),
f2 AS (SELECT fc.*, oh.ohd,
         CASE WHEN oh.ohd IS NULL THEN NULL
              WHEN datediff('day', oh.ohd, {AS_OF}) > 0 AND avg0 > 0
                THEN GREATEST(0.0, oh.oh_qty - avg0 * datediff('day', oh.ohd, {AS_OF}))
              ELSE oh.oh_qty END AS on_hand,
         CASE WHEN oh.ohd IS NULL AND conf0 = 'high' THEN 'medium' ELSE conf0 END AS confidence_level
       FROM fc LEFT JOIN oh USING (store_id, item_id)),
rc AS (SELECT *,
         CASE WHEN avg0 = 0 AND data_points = 0 THEN par_level ELSE avg0 END AS favg,
         GREATEST(par_level, (CASE WHEN avg0 = 0 AND data_points = 0 THEN par_level ELSE avg0 END)
                  + safety_stock) AS target,
         CASE WHEN case_pack_quantity IS NULL OR case_pack_quantity <= 0 THEN 1.0
              ELSE CAST(case_pack_quantity AS DOUBLE) END AS cp
       FROM f2),
rc2 AS (SELECT *, GREATEST(0.0, target - COALESCE(on_hand, 0.0)) AS need0 FROM rc),
rc3 AS (SELECT *, CASE WHEN need0 > 0 AND need0 < min_send_quantity THEN min_send_quantity ELSE need0 END AS need1
        FROM rc2),
rc4 AS (SELECT *, CASE WHEN need1 <= 0 THEN 0.0
                       WHEN rounding_rule = 'round_up_integer' THEN ceil(round_even(need1, 6))
                       WHEN rounding_rule = 'round_up_case_pack' THEN ceil(round_even(need1 / cp, 6)) * cp
                       ELSE need1 END AS need2 FROM rc3),
rec AS (SELECT *, CASE WHEN need2 > 0 THEN ceil(round_even(need2, 6)) ELSE need2 END AS recommended_quantity
        FROM rc4),
recw AS (SELECT *, concat_ws(',',
           CASE WHEN lane = 'dormant' THEN 'dormant_product' END,
           CASE WHEN lane = 'intermittent' THEN 'intermittent_demand' END,
           CASE WHEN lane = 'periodic' THEN 'periodic_demand' END,
           CASE WHEN lane = 'dormant' OR (lane = 'daily' AND pick NOT IN ('S', 'L')) OR lane_low
                THEN 'sparse_usage_history' END,
           CASE WHEN lane = 'daily' AND low_cov THEN 'low_data_coverage' END,
           CASE WHEN lane = 'daily' AND sparse_dow THEN 'sparse_dow_history' END,
           CASE WHEN conf0 = 'low' THEN 'low_confidence' END,
           CASE WHEN ohd IS NULL THEN 'missing_snapshot' END,
           CASE WHEN recommended_quantity > par_level * 2 AND par_level > 0
                THEN 'unusual_recommendation' END) AS warning_flags
         FROM rec)"""


def _app_with(weighted=False, m=0.0, decay=WEIGHTED_DECAY, override="",
              periodic="false") -> str:
    return with_(app_table_ctes(), overlay_cte(), app_stat_ctes(decay, m),
                 app_forecast_ctes(weighted, m, override, periodic))


def q_recommendation_lanes() -> str:
    """Some items periodic, one of each lane fixed by an override."""
    lanes = {"Item 1": "periodic", "Item 3": "daily", "Item 5": "dormant", "Item 7": "intermittent"}
    override = " ".join(f"WHEN item_name = '{k}' THEN '{v}'" for k, v in lanes.items())
    periodic = "item_id % 2 = 0 AND item_id < 400"
    return q_recommendation(override=override, periodic=periodic)


def q_recommendation(weighted: bool = False, m: float = 0.0, override: str = "",
                     periodic: str = "false") -> str:
    return _app_with(weighted, m, override=override, periodic=periodic) + f"""
SELECT store_id, item_id, lane, {r6('recommended_quantity')} AS recommended_quantity,
       confidence_level, forecast_method, {r6('favg')} AS forecast_avg_daily_usage,
       {r6('on_hand')} AS on_hand, {r6('target')} AS forecast_target, window_days, data_points,
       data_source, warning_flags
FROM recw"""


def q_plan_generate() -> str:
    return _app_with() + f"""
SELECT CAST(1 AS BIGINT) AS plan_id, store_id, item_id, {r6('recommended_quantity')} AS recommended_quantity,
       'pending' AS status, confidence_level, forecast_method,
       {r6('favg')} AS forecast_avg_daily_usage, {r6('on_hand')} AS forecast_on_hand,
       {r6('target')} AS forecast_target, true AS has_id, true AS has_text
FROM recw WHERE recommended_quantity > 0"""


def q_plan_stats() -> str:
    return _app_with() + """
SELECT COUNT(*) FILTER (WHERE recommended_quantity > 0) AS lines,
       COUNT(DISTINCT CASE WHEN recommended_quantity > 0 THEN store_id END) AS stores,
       COUNT(*) FILTER (WHERE recommended_quantity > 0 AND confidence_level = 'low') AS low_confidence,
       COUNT(*) FILTER (WHERE recommended_quantity > 0 AND warning_flags <> '') AS with_warnings,
       COUNT(*) FILTER (WHERE NOT recommended_quantity > 0) AS zero_skipped
FROM recw"""


def q_avg_orders() -> str:
    return with_(app_table_ctes(), overlay_cte(), app_stat_ctes()) + f"""
SELECT store_id, item_id, {r6('avg_s')} AS avg_short, n_s AS count_short, src_s AS source_short,
       {r6('avg_l')} AS avg_long, n_l AS count_long, src_l AS source_long FROM s2"""


def q_weighted_avg_orders(m: float = 0.5) -> str:
    return with_(app_table_ctes(), overlay_cte(), app_stat_ctes(WEIGHTED_DECAY, m)) + f"""
SELECT store_id, item_id, {r6('wavg_s')} AS wavg_short, n_s AS count_short, dowm_s AS dow_matches_short,
       {r6('wavg_l')} AS wavg_long, n_l AS count_long, dowm_l AS dow_matches_long FROM s2"""


def q_demand_stats() -> str:
    return with_(app_table_ctes(), overlay_cte(), app_stat_ctes()) + f"""
SELECT store_id, item_id, {r6('zr')} AS zero_rate, {r6('r_avg')} AS avg_demand,
       {r6('anz')} AS avg_nonzero, {r6('r_cv')} AS cv, r_n AS n_days, r_no AS n_order_days FROM s2"""


def q_latest_on_hand() -> str:
    return with_(app_table_ctes()) + f"""
SELECT store_id, item_id, arg_max(quantity_on_hand, snapshot_date) AS on_hand,
       MAX(snapshot_date) AS on_hand_date
FROM snaps WHERE snapshot_date <= {AS_OF} GROUP BY store_id, item_id"""


def q_overlay_demand() -> str:
    return with_(app_table_ctes(), overlay_cte(USAGE_WINDOW_LONG)) + f"""
SELECT store_id, item_id, date, {r6('qty')} AS qty, has_usage, has_order FROM ov"""


APP_SQL = {
    "overlay_demand": q_overlay_demand,
    "avg_orders": q_avg_orders,
    "weighted_avg_orders": q_weighted_avg_orders,
    "demand_stats": q_demand_stats,
    "latest_on_hand": q_latest_on_hand,
    "recommendation": lambda: q_recommendation(False),
    "recommendation_weighted": lambda: q_recommendation(True, 0.5),
    "plan_stats": q_plan_stats,
    "plan_generate": q_plan_generate,
    "recommendation_lanes": q_recommendation_lanes,
}


# --------------------------------------------------------------------------
# safety stock, delivery schedule, packing (on the brand lane forecast)
# --------------------------------------------------------------------------

SPORADIC_EXAMPLE = ("Brand#3", "Brand#13", "Brand#23")


def packing_ctes() -> str:
    spor = ", ".join(f"'{p}'" for p in SPORADIC_EXAMPLE)
    m = SAFETY_MULTIPLIER
    return f"""
lf AS (SELECT h.store, h.product, l.lane, h.day_idx, h.date,
         CASE WHEN l.lane = 'daily' THEN (CASE WHEN t.tot = 0 THEN 0.0
                   ELSE GREATEST(0.0, COALESCE(p.dow_avg, 0.0) * t.trend2) END)
              WHEN l.lane = 'intermittent' THEN l.intermittent_rate ELSE 0.0 END AS pred
       FROM horizon2 h JOIN lanes2 l ON h.store = l.store AND h.product = l.product
       JOIN trend t ON h.store = t.store AND h.product = t.product
       LEFT JOIN prof2 p ON p.store = h.store AND p.product = h.product AND p.dow = h.dow),
ss AS (SELECT store, product, SUM(qty) AS tot, COUNT(*) FILTER (WHERE qty > 0) AS nzc,
              AVG(qty) FILTER (WHERE qty > 0) AS nzm, STDDEV_SAMP(qty) FILTER (WHERE qty > 0) AS nzs,
              AVG(CASE WHEN qty > 0 THEN 1.0 ELSE 0.0 END) AS ofq
       FROM dense GROUP BY store, product),
sf AS (SELECT lf.*, ss.tot, ss.ofq, ss.nzm,
         lf.pred * CASE WHEN (CASE WHEN ss.nzc > 1 AND ss.nzm > 0 THEN ss.nzs / ss.nzm ELSE 0.0 END) > {SAFETY_VOLATILE_CV}
                        THEN {m + SAFETY_VOLATILE_EXTRA} ELSE {m} END AS p1,
         GREATEST(1.0, round_even(COALESCE(ss.nzm, 1.0) * 0.5, 0)) AS floor_q
       FROM lf LEFT JOIN ss USING (store, product)),
safe AS (SELECT store, product, lane, day_idx, date,
           CASE WHEN tot IS NULL OR tot = 0 THEN pred
                WHEN product IN ({spor}) AND ofq > {SPORADIC_MIN_ORDER_FREQ} AND p1 > 0 AND p1 < floor_q
                  THEN floor_q
                ELSE p1 END AS pred
         FROM sf),
sched0 AS (SELECT store, product, n_order_days AS k,
             GREATEST(1.0, round_even(n_days / n_order_days, 0)) AS itv,
             GREATEST(1.0, round_even(window_nonzero_qty / n_order_days, 0)) AS aq
           FROM lanes2 WHERE lane IN ('intermittent', 'periodic')),
sched AS (SELECT s.store, s.product, CAST(d.day_idx AS BIGINT) AS day_idx,
            CASE WHEN s.k > 0 AND ({HORIZON_DAYS} / s.itv) * s.aq >= 0.5
                      AND d.day_idx % CAST(s.itv AS BIGINT) = 0 THEN s.aq ELSE 0.0 END AS qty
          FROM sched0 s CROSS JOIN (SELECT unnest(range(0, {HORIZON_DAYS})) AS day_idx) d),
pq AS (SELECT f.store, f.product, f.day_idx, f.date,
         CASE WHEN f.lane IN ('intermittent', 'periodic') THEN COALESCE(s.qty, 0.0)
              ELSE round_even(f.pred, 0) END AS qty
       FROM safe f LEFT JOIN sched s ON s.store = f.store AND s.product = f.product AND s.day_idx = f.day_idx),
par AS (SELECT DISTINCT store, product,
               CAST(((length(store) + length(product)) % 4) * 10 AS BIGINT) AS max_qty FROM lines),
keep AS (SELECT store, product, SUM(qty) AS total FROM pq GROUP BY store, product HAVING SUM(qty) >= 1),
pl0 AS (SELECT pq.store, pq.product, pq.day_idx, pq.date,
          CASE WHEN par.max_qty IS NULL THEN pq.qty ELSE LEAST(pq.qty, CAST(par.max_qty AS DOUBLE)) END AS qty,
          keep.total, CAST(par.max_qty AS DOUBLE) AS par
        FROM pq JOIN keep USING (store, product) LEFT JOIN par USING (store, product)),
pl AS (SELECT pl0.*, SUM(qty) OVER (PARTITION BY store, product) AS capped_total FROM pl0)"""


def _packing_with() -> str:
    return with_(demand_ctes("brand"), lane_ctes(), dow_ctes(), packing_ctes())


def q_safety_stock() -> str:
    return _packing_with() + f"""
SELECT store, product, lane, day_idx, date, {r6('pred')} AS pred FROM safe"""


def q_delivery_schedule() -> str:
    return _packing_with() + f"""
SELECT store, product, day_idx, {r6('qty')} AS qty FROM sched"""


def q_packing_list() -> str:
    return _packing_with() + f"""
SELECT store, product, day_idx, date, {r6('qty')} AS qty, {r6('total')} AS total,
       {r6('capped_total')} AS capped_total, {r6('par')} AS par FROM pl"""


def q_packing_totals() -> str:
    return _packing_with() + f"""
SELECT store, day_idx, {r6('SUM(qty)')} AS total FROM pl GROUP BY ROLLUP (store, day_idx)
HAVING store IS NOT NULL"""


def q_check_stock() -> str:
    return _packing_with() + """
SELECT store, product, max_qty AS par FROM par
WHERE max_qty > 0 AND NOT EXISTS (SELECT 1 FROM pl WHERE pl.store = par.store AND pl.product = par.product)"""


PACKING_SQL = {
    "safety_stock": q_safety_stock,
    "delivery_schedule": q_delivery_schedule,
    "packing_list": q_packing_list,
    "packing_totals": q_packing_totals,
    "check_stock": q_check_stock,
}


# --------------------------------------------------------------------------
# hold-out backtest (DOW + lane configuration) and accuracy report
# --------------------------------------------------------------------------

def backtest_ctes(kind: str = "brand") -> str:
    """``daily`` = full daily sums, ``bounds`` = (first day, training end),
    ``dense`` = zero-filled training rows, ``test`` = zero-filled actuals."""
    mt, td = BACKTEST_MIN_TRAIN, BACKTEST_TEST_DAYS
    return f"""
lines AS ({lines_sql(kind)}),
daily AS (SELECT store, product, date, SUM(qty) AS qty FROM lines GROUP BY store, product, date),
b0 AS (SELECT MIN(date) AS d0, MAX(date) AS d1, datediff('day', MIN(date), MAX(date)) AS hist FROM daily),
bt AS (SELECT d0, d1, CASE WHEN hist < {mt + td} THEN GREATEST(1, hist - {mt}) ELSE {td} END AS td FROM b0),
bounds AS (SELECT d0, CAST(d1 - CAST(td AS INTEGER) AS DATE) AS d1 FROM bt),
grid AS (
  SELECT p.store, p.product,
         CAST(unnest(generate_series(b.d0, b.d1, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT DISTINCT store, product FROM daily) p CROSS JOIN bounds b),
dense AS (
  SELECT g.store, g.product, g.date, COALESCE(d.qty, 0.0) AS qty,
         datediff('day', g.date, (SELECT d1 FROM bounds)) AS days_ago,
         isodow(g.date) - 1 AS dow
  FROM grid g LEFT JOIN daily d
    ON d.store = g.store AND d.product = g.product AND d.date = g.date)"""


def q_backtest_lanes(kind: str = "brand") -> str:
    return with_(backtest_ctes(kind), lane_ctes(), dow_ctes("(SELECT td FROM bt)")) + f"""
, res AS (
  SELECT h.store, h.product, h.date, COALESCE(d.qty, 0.0) AS actual, l.lane,
    CASE WHEN l.lane = 'daily' THEN NULL WHEN l.lane = 'intermittent'
         THEN round_even(l.intermittent_rate, 2) ELSE 0.0 END AS pred_lane,
    CASE WHEN l.lane = 'daily' THEN round_even(CASE WHEN t.tot = 0 THEN 0.0
         ELSE GREATEST(0.0, COALESCE(p.dow_avg, 0.0) * t.trend2) END, 1) END AS pred_dow
  FROM horizon2 h JOIN lanes2 l ON h.store = l.store AND h.product = l.product
  JOIN trend t ON h.store = t.store AND h.product = t.product
  LEFT JOIN prof2 p ON p.store = h.store AND p.product = h.product AND p.dow = h.dow
  LEFT JOIN daily d ON d.store = h.store AND d.product = h.product AND d.date = h.date
  WHERE (h.store, h.product) IN (SELECT store, product FROM daily GROUP BY store, product
                                 HAVING SUM(qty) <> 0)
    AND (SELECT datediff('day', d0, d1) + 1 FROM bounds) >= {BACKTEST_MIN_TRAIN_ROWS}),
filled AS (SELECT store, product, date, actual, lane,
    CASE WHEN lane = 'daily' THEN (0.0 + {DEFAULT_WEIGHTS['dow']} * pred_dow) / (0.0 + {DEFAULT_WEIGHTS['dow']})
         ELSE pred_lane END AS pred_lane, pred_dow FROM res)"""


def _metrics(a: str = "actual", p: str = "pred") -> str:
    return (f"round_even(AVG(abs({a} - {p})), 2) AS mae, "
            f"round_even(AVG(CASE WHEN {a} > 0 THEN abs(({a} - {p}) / {a}) END) * 100, 1) AS mape, "
            f"round_even(SUM(abs({a} - {p})) / GREATEST(SUM({a}), 1.0) * 100, 1) AS wmape, "
            f"round_even(AVG({p} - {a}), 2) AS bias, "
            f"round_even(AVG(CASE WHEN abs({a} - {p}) <= 1 THEN 1.0 WHEN abs({a} - {p}) > 1 THEN 0.0 END)"
            " * 100, 1) AS within_1")


def q_backtest_rows() -> str:
    return q_backtest_lanes() + f"""
SELECT store, product, date, {r6('actual')} AS actual, lane, {r6('pred_lane')} AS pred_lane,
       {r6('pred_dow')} AS pred_dow FROM res"""


def q_accuracy_by_lane() -> str:
    return q_backtest_lanes() + f"""
, lg AS (
  SELECT store, product, lane, actual, 'ensemble' AS model, pred_lane AS pred FROM filled WHERE lane = 'daily'
  UNION ALL SELECT store, product, lane, actual, 'dow', pred_dow FROM filled WHERE lane = 'daily'
  UNION ALL SELECT store, product, lane, actual, 'lane', pred_lane FROM filled WHERE lane <> 'daily'),
lg2 AS (SELECT *, model IN ('ensemble', 'lane') AND lane <> 'dormant' AS final FROM lg WHERE pred IS NOT NULL),
g AS (SELECT lane, model, final, store, COUNT(*) AS n, COUNT(DISTINCT (store, product)) AS products,
             {_metrics()}
      FROM lg2 GROUP BY GROUPING SETS ((lane, model), (final, store), (final)))
SELECT CASE WHEN lane IS NOT NULL THEN 'lane' WHEN store IS NOT NULL THEN 'store' ELSE 'overall' END AS scope,
       COALESCE(lane, store, 'all') AS key, COALESCE(model, 'final') AS model, n, products,
       {r6('mae')} AS mae, {r6('mape')} AS mape, {r6('wmape')} AS wmape, {r6('bias')} AS bias,
       {r6('within_1')} AS within_1
FROM g WHERE lane IS NOT NULL OR final"""


def q_lane_distribution() -> str:
    return q_backtest_lanes() + """
SELECT lane, COUNT(DISTINCT (store, product)) AS series FROM res GROUP BY lane"""


def q_worst_products() -> str:
    return q_backtest_lanes() + f"""
SELECT store, product, lane, {r6('wmape')} AS wmape, {r6('mae')} AS mae, {r6('total_actual')} AS total_actual
FROM (SELECT store, product, MAX(lane) AS lane, SUM(actual) AS total_actual, {_metrics('actual', 'pred_lane')}
      FROM filled WHERE lane <> 'dormant' GROUP BY store, product HAVING SUM(actual) >= 2)
ORDER BY wmape DESC, store, product LIMIT 10"""


BACKTEST_SQL = {
    "backtest_lanes": q_backtest_rows,
    "accuracy_by_lane": q_accuracy_by_lane,
    "lane_distribution": q_lane_distribution,
    "worst_products": q_worst_products,
}


# --------------------------------------------------------------------------
# feedback loop (history derived from the type demand)
# --------------------------------------------------------------------------

def history_ctes() -> str:
    """``hist`` = the recorded-forecast fixture; needs ``daily``/``bounds``."""
    fut, pend = 7, 14
    return f"""
hgrid AS (SELECT p.store, p.product,
            CAST(unnest(generate_series(b.d0, b.d1 + {fut}, INTERVAL 1 DAY)) AS DATE) AS date
          FROM (SELECT DISTINCT store, product FROM daily) p CROSS JOIN bounds b),
hist0 AS (SELECT g.store, g.product, g.date, COALESCE(d.qty, 0.0) AS q,
            dayofmonth(g.date) AS dom, (SELECT d1 FROM bounds) AS d1
          FROM hgrid g LEFT JOIN daily d
            ON d.store = g.store AND d.product = g.product AND d.date = g.date),
hist1 AS (SELECT store, product, date, q,
            CASE WHEN date > d1 THEN CAST(dom % 4 + 1 AS DOUBLE)
                 ELSE round_even(q * (CAST(0.8 AS DOUBLE) + (dom % 5) * CAST(0.1 AS DOUBLE)) + dom % 3, 0)
            END AS predicted,
            CASE WHEN date <= d1 - {pend} THEN q END AS actual
          FROM hist0),
hist AS (SELECT store, product, date, predicted, actual,
           CASE WHEN actual IS NOT NULL THEN round_even((predicted - actual) * 100, 0) / 100 END AS error,
           CASE WHEN q >= 5 THEN 'high' ELSE 'low' END AS volume_tier, 'v2' AS model_version,
           CAST(date AS TIMESTAMP) AS recorded_at
         FROM hist1),
matched AS (
  SELECT h.store, h.product, h.date, h.predicted,
    CASE WHEN d.qty IS NOT NULL THEN d.qty WHEN h.date <= (SELECT MAX(date) FROM daily) THEN 0.0
         ELSE h.actual END AS actual, h.actual AS old_actual, h.error AS old_error,
    h.volume_tier, h.model_version, h.recorded_at
  FROM hist h LEFT JOIN daily d ON d.store = h.store AND d.product = h.product AND d.date = h.date),
matched2 AS (
  SELECT store, product, date, predicted, actual,
    CASE WHEN actual IS DISTINCT FROM old_actual THEN round_even((predicted - actual) * 100, 0) / 100
         ELSE old_error END AS error,
    volume_tier, model_version, recorded_at, actual IS DISTINCT FROM old_actual AS changed
  FROM matched),
factors AS (
  SELECT store, product,
    round_even(LEAST(GREATEST(SUM(actual) / SUM(predicted), 0.5), 2.0) * 1000, 0) / 1000 AS factor
  FROM matched2 WHERE actual IS NOT NULL AND actual > 0
  GROUP BY store, product HAVING COUNT(*) >= {CORRECTION_MIN_POINTS} AND SUM(predicted) > 0)"""


def _fb_with() -> str:
    return with_(demand_ctes("type"), history_ctes())


def q_match_actuals() -> str:
    return _fb_with() + f"""
SELECT store, product, date, {r6('predicted')} AS predicted, {r6('actual')} AS actual,
       {r6('error')} AS error, volume_tier, model_version, recorded_at, changed FROM matched2"""


def q_correction_factors() -> str:
    return _fb_with() + f"SELECT store, product, {r6('factor')} AS factor FROM factors"


def q_confidence_score() -> str:
    w = CONFIDENCE_WEIGHTS
    return _fb_with() + f"""
, g AS (SELECT store, product, COUNT(*) AS n, AVG(abs(actual - predicted)) AS mae,
               AVG(actual) AS av, STDDEV_POP(actual) AS sd
        FROM matched2 WHERE actual IS NOT NULL GROUP BY store, product),
g2 AS (SELECT g.*, COALESCE(f.factor, 1.0) AS factor,
              CASE WHEN av > 0 THEN (CASE WHEN n > 1 THEN sd ELSE 0.0 END) / av ELSE 0.0 END AS cv
       FROM g LEFT JOIN factors f USING (store, product)),
g3 AS (SELECT *,
   LEAST(100.0, n / 14.0 * 100) * {w['data']}
   + (CASE WHEN av > 0 THEN GREATEST(0.0, (1 - mae / av) * 100) WHEN mae = 0 THEN 50.0 ELSE 0.0 END) * {w['accuracy']}
   + GREATEST(0.0, (1 - LEAST(cv, 2.0) / 2) * 100) * {w['stability']}
   + GREATEST(0.0, (1 - abs(factor - 1)) * 100) * {w['calibration']} AS score FROM g2)
SELECT store, product,
  CASE WHEN score >= {CONFIDENCE_HIGH} THEN 'High' WHEN score >= {CONFIDENCE_MEDIUM} THEN 'Medium'
       ELSE 'Low' END AS confidence,
  {r6('round_even(score, 1)')} AS score, n AS data_points, {r6('round_even(mae, 2)')} AS avg_mae,
  {r6('round_even(av, 2)')} AS avg_demand, {r6('round_even(cv, 2)')} AS demand_cv,
  {r6('factor')} AS correction_factor
FROM g3"""


def q_accuracy_summary() -> str:
    return _fb_with() + f"""
SELECT m.store, m.product, COUNT(*) AS forecasts,
  {r6('round_even(AVG(abs(actual - predicted)), 2)')} AS mae,
  {r6('round_even(SUM(abs(actual - predicted)) / GREATEST(SUM(actual), 1.0) * 100, 1)')} AS wmape,
  {r6('round_even(AVG(predicted - actual), 2)')} AS bias,
  {r6('COALESCE(MAX(f.factor), 1.0)')} AS correction_factor
FROM matched2 m LEFT JOIN factors f ON f.store = m.store AND f.product = m.product
WHERE actual IS NOT NULL GROUP BY m.store, m.product"""


def q_forecast_vs_actual() -> str:
    return _fb_with() + """
SELECT date, store, product, CAST(trunc(predicted) AS BIGINT) AS predicted,
       CAST(trunc(actual) AS BIGINT) AS actual,
       abs(CAST(trunc(predicted) AS BIGINT) - CAST(trunc(actual) AS BIGINT)) AS mae
FROM matched2 WHERE actual IS NOT NULL"""


def q_feedback_summary() -> str:
    return _fb_with() + f"""
SELECT COUNT(*) AS total, COUNT(actual) AS completed, COUNT(*) - COUNT(actual) AS pending,
  {_metrics('actual', 'predicted')}
FROM matched2"""


def q_gap_rows() -> str:
    return _fb_with() + f"""
, older AS (SELECT * FROM hist WHERE date <= (SELECT d1 FROM bounds) - 10)
SELECT d.store, d.product, d.date, {r6('d.qty')} AS qty FROM dense d
WHERE d.date > (SELECT MAX(date) FROM older)
  AND NOT EXISTS (SELECT 1 FROM older o WHERE o.store = d.store AND o.product = d.product AND o.date = d.date)"""


def q_history_upsert() -> str:
    return with_(demand_ctes("type"), history_ctes(), lane_ctes(), dow_ctes()) + f"""
, tiers AS (SELECT store, product, {_tier('AVG(qty)')} AS tier FROM dense GROUP BY store, product),
newf AS (
  SELECT h.store, h.product, h.date,
    round_even(CASE WHEN l.lane = 'daily' THEN (CASE WHEN t.tot = 0 THEN 0.0
          ELSE GREATEST(0.0, COALESCE(p.dow_avg, 0.0) * t.trend2) END)
         WHEN l.lane = 'intermittent' THEN l.intermittent_rate ELSE 0.0 END, 0) AS n_pred,
    ti.tier AS n_tier,
    CASE l.lane WHEN 'dormant' THEN 'dormant' WHEN 'intermittent' THEN 'intermittent_v1'
                WHEN 'periodic' THEN 'periodic_v1' ELSE 'ensemble_v2' END AS n_model
  FROM horizon2 h JOIN lanes2 l ON h.store = l.store AND h.product = l.product
  JOIN trend t ON h.store = t.store AND h.product = t.product
  LEFT JOIN prof2 p ON p.store = h.store AND p.product = h.product AND p.dow = h.dow
  JOIN tiers ti ON ti.store = h.store AND ti.product = h.product),
up AS (
  SELECT COALESCE(h.store, n.store) AS store, COALESCE(h.product, n.product) AS product,
         COALESCE(h.date, n.date) AS date,
         CASE WHEN n.n_pred IS NOT NULL THEN n.n_pred ELSE h.predicted END AS predicted,
         h.actual, h.error,
         CASE WHEN n.n_pred IS NOT NULL THEN n.n_tier ELSE h.volume_tier END AS volume_tier,
         CASE WHEN n.n_pred IS NOT NULL THEN n.n_model ELSE h.model_version END AS model_version,
         CASE WHEN n.n_pred IS NOT NULL THEN CAST((SELECT d1 FROM bounds) + 1 AS TIMESTAMP)
              ELSE h.recorded_at END AS recorded_at
  FROM hist h FULL OUTER JOIN newf n ON h.store = n.store AND h.product = n.product AND h.date = n.date)
SELECT store, product, date, {r6('predicted')} AS predicted, {r6('actual')} AS actual, {r6('error')} AS error,
       volume_tier, model_version, recorded_at FROM up"""


FEEDBACK_SQL = {
    "match_actuals": q_match_actuals,
    "correction_factors": q_correction_factors,
    "confidence_score": q_confidence_score,
    "accuracy_summary": q_accuracy_summary,
    "forecast_vs_actual": q_forecast_vs_actual,
    "feedback_summary": q_feedback_summary,
    "gap_rows": q_gap_rows,
    "history_upsert": q_history_upsert,
}


# --------------------------------------------------------------------------
# warehouse reports (plan lines from lineitem ⋈ orders, one plan per day)
# --------------------------------------------------------------------------

def plan_ctes() -> str:
    st = D.PRIORITY_TO_STATUS
    cf = D.RETURNFLAG_TO_CONFIDENCE
    st_case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in st.items())
    cf_case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cf.items())
    pid = "CAST(year({d}) * 10000 + month({d}) * 100 + day({d}) AS BIGINT)"
    return f"""
pl0 AS (SELECT {pid.format(d='l.l_shipdate')} AS plan_id, l.l_suppkey AS store_id, l.l_partkey AS item_id,
               MIN(l.l_orderkey * 10 + l.l_linenumber) AS id, SUM(l.l_quantity) AS recommended_quantity,
               MIN(o.o_orderpriority) AS prio, MAX(l.l_returnflag) AS flag, MAX(l.l_discount) AS disc,
               MAX(o.o_orderdate) AS last_status_change_at
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2, 3),
pl1 AS (SELECT *, CASE prio {st_case} ELSE 'delivered' END AS status,
               CASE flag {cf_case} ELSE 'low' END AS confidence_level FROM pl0),
lines AS (SELECT id, plan_id, store_id, item_id, recommended_quantity,
            CASE WHEN status = 'pending' THEN NULL WHEN status = 'shorted'
                 THEN CAST(floor(recommended_quantity / 2) AS DOUBLE) ELSE recommended_quantity END
              AS actual_quantity,
            status, confidence_level,
            list_concat(
              CASE WHEN confidence_level = 'low' THEN ['low_confidence'] ELSE CAST([] AS VARCHAR[]) END,
              CASE WHEN disc >= 0.08 THEN ['missing_snapshot'] ELSE CAST([] AS VARCHAR[]) END,
              CASE WHEN recommended_quantity > 100 THEN ['unusual_recommendation']
                   ELSE CAST([] AS VARCHAR[]) END) AS warning_flags,
            last_status_change_at
          FROM pl1),
plans AS (SELECT DISTINCT {pid.format(d='l_shipdate')} AS id, CAST(l_shipdate AS DATE) AS plan_date,
            CASE WHEN day(l_shipdate) <= 10 THEN 'completed' WHEN day(l_shipdate) <= 20 THEN 'in_progress'
                 ELSE 'draft' END AS status FROM lineitem),
pstores AS (SELECT s_suppkey AS id, s_name AS name FROM supplier),
pitems AS (SELECT p_partkey AS id, p_name AS item_name, 'P-' || CAST(p_partkey AS VARCHAR) AS sku,
                  p_type AS category FROM part),
porders AS (SELECT l_suppkey AS store_id, l_partkey AS item_id, CAST(l_shipdate AS DATE) AS order_date,
                   CAST(SUM(floor(l_quantity * (1 - l_discount) + l_tax * 20)) AS DOUBLE) AS quantity_ordered
            FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2, 3),
audit AS (SELECT l_orderkey * 10 + l_linenumber AS id,
                 CASE WHEN l_returnflag = 'N' THEN 'plan' ELSE 'plan_line' END AS entity_type,
                 l_orderkey * 10 + l_linenumber AS entity_id,
                 CASE WHEN l_linestatus = 'F' THEN 'status_change' ELSE 'quantity_change' END AS action,
                 l_shipdate AS changed_at FROM lineitem)"""


def _pick_list_sql(category: str | None = None, search: str | None = None) -> str:
    cond = []
    if category:
        cond.append(f"i.category = '{category}'")
    if search:
        cond.append(f"(i.item_name ILIKE '%{search}%' OR i.sku ILIKE '%{search}%')")
    where = ("WHERE " + " AND ".join(cond)) if cond else ""
    return with_(plan_ctes()) + f"""
SELECT l.plan_id, l.item_id, i.item_name, i.sku, i.category,
       {r6('SUM(l.recommended_quantity)')} AS total_recommended,
       {r6('SUM(COALESCE(l.actual_quantity, 0.0))')} AS total_actual,
       COUNT(DISTINCT l.store_id) AS store_count
FROM lines l JOIN pitems i ON i.id = l.item_id {where}
GROUP BY l.plan_id, l.item_id, i.item_name, i.sku, i.category"""


def q_status_pivot() -> str:
    cols = ", ".join(f"COUNT(*) FILTER (WHERE status = '{s}') AS {s}" for s in LINE_STATUSES)
    return with_(plan_ctes()) + f"SELECT plan_id, item_id, {cols} FROM lines GROUP BY plan_id, item_id"


def event_ctes() -> str:
    """Status events, their rejects and the valid ones in order; needs ``plan_ctes``."""
    return """
klines AS (SELECT * REPLACE ((plan_id * 100000 + store_id) * 1000000 + item_id AS id) FROM lines),
ev AS (SELECT CASE WHEN id % 50 = 0 AND seq = 1 THEN -id ELSE id END AS line_id,
         CASE WHEN seq = 1 THEN CASE WHEN id % 5 = 0 THEN 'lost' ELSE 'picked' END
              WHEN seq = 3 AND id % 3 = 0 THEN 'loaded' END AS status,
         CASE WHEN seq = 1 THEN recommended_quantity
              WHEN seq = 2 THEN CASE id % 7 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN NULL
                WHEN 2 THEN CAST('inf' AS DOUBLE) WHEN 3 THEN -1.0 ELSE recommended_quantity - 1 END
         END AS actual_quantity,
         CASE WHEN seq = 3 AND id % 4 = 0 THEN 'late' END AS picker_note,
         CASE WHEN id % 2 = 0 THEN CAST(last_status_change_at AS TIMESTAMP)
              ELSE CAST(CAST(last_status_change_at AS DATE) + CAST(seq AS INTEGER) AS TIMESTAMP) END
           AS changed_at, CAST(seq AS BIGINT) AS seq
       FROM klines CROSS JOIN (SELECT unnest([1, 2, 3]) AS seq)),
judged AS (SELECT e.*, l.status AS line_status, l.actual_quantity AS line_quantity,
         CASE WHEN l.id IS NULL THEN 'unknown_line'
              WHEN e.status NOT IN ('pending', 'picked', 'shorted', 'loaded', 'delivered')
                THEN 'invalid_status'
              WHEN isnan(e.actual_quantity) OR isinf(e.actual_quantity) THEN 'invalid_quantity'
              WHEN e.actual_quantity < 0 THEN 'negative_quantity'
              WHEN e.status IS NULL AND e.actual_quantity IS NULL AND e.picker_note IS NULL
                THEN 'nothing_to_change' END AS reject_reason
       FROM ev e LEFT JOIN klines l ON l.id = e.line_id),
good AS (SELECT *,
         COALESCE(last_value(status IGNORE NULLS) OVER w, line_status) AS old_status,
         COALESCE(last_value(actual_quantity IGNORE NULLS) OVER w, line_quantity) AS old_quantity
       FROM judged WHERE reject_reason IS NULL
       WINDOW w AS (PARTITION BY line_id ORDER BY changed_at, seq
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def q_line_status_apply() -> str:
    return with_(plan_ctes(), event_ctes()) + f"""
, last_of AS (SELECT line_id,
    arg_max(status, (changed_at, seq)) FILTER (WHERE status IS NOT NULL) AS status,
    arg_max(actual_quantity, (changed_at, seq)) FILTER (WHERE actual_quantity IS NOT NULL) AS qty,
    arg_max(picker_note, (changed_at, seq)) FILTER (WHERE picker_note IS NOT NULL) AS note
  FROM good GROUP BY line_id)
SELECT l.id, l.plan_id, COALESCE(n.status, l.status) AS status,
       {r6('COALESCE(n.qty, l.actual_quantity)')} AS actual_quantity, n.note AS picker_note
FROM klines l LEFT JOIN last_of n ON n.line_id = l.id"""


def q_line_status_audit() -> str:
    return with_(plan_ctes(), event_ctes()) + """
SELECT line_id AS entity_id, old_status AS old_value, concat_ws('; ',
    CASE WHEN status IS NOT NULL THEN 'status: ' || old_status || ' -> ' || status END,
    CASE WHEN actual_quantity IS NOT NULL THEN 'actual_qty: '
      || COALESCE(CAST(old_quantity AS VARCHAR), 'None') || ' -> '
      || CAST(actual_quantity AS VARCHAR) END,
    CASE WHEN picker_note IS NOT NULL THEN 'note updated' END) AS new_value, changed_at, seq
FROM good"""


def q_line_status_rejects() -> str:
    return with_(plan_ctes(), event_ctes()) + """
SELECT line_id, seq, reject_reason FROM judged WHERE reject_reason IS NOT NULL"""


def q_store_breakdown() -> str:
    return with_(plan_ctes()) + """
SELECT l.plan_id, l.item_id, s.name AS store_name, l.recommended_quantity AS recommended,
       l.actual_quantity AS actual, l.status,
       ROW_NUMBER() OVER (PARTITION BY l.plan_id, l.item_id ORDER BY s.name, l.id) AS position
FROM lines l JOIN pstores s ON s.id = l.store_id"""


def q_dashboard() -> str:
    cnt = ", ".join(f"COUNT(*) FILTER (WHERE status = '{s}') AS {s}_lines" for s in LINE_STATUSES)
    pct = ", ".join(f"round_even(CAST({s}_lines AS DOUBLE) * 100.0 / GREATEST(total_lines, 1), 1) AS {s}_pct"
                    for s in LINE_STATUSES)
    return with_(plan_ctes()) + f"""
, g AS (SELECT plan_id, COUNT(*) AS total_lines, SUM(recommended_quantity) AS total_quantity,
               COUNT(DISTINCT store_id) AS total_stores, {cnt} FROM lines GROUP BY plan_id)
SELECT g.plan_id, total_lines, {r6('total_quantity')} AS total_quantity, total_stores,
       {', '.join(f'{s}_lines' for s in LINE_STATUSES)}, {pct},
       p.plan_date, p.status AS plan_status
FROM g JOIN plans p ON p.id = g.plan_id"""


def q_delivery_progress() -> str:
    return with_(plan_ctes()) + """
SELECT plan_id, store_id, status, COUNT(*) AS n,
       round_even(CAST(COUNT(*) AS DOUBLE) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY plan_id, store_id), 1) AS pct
FROM lines GROUP BY plan_id, store_id, status"""


def q_exceptions() -> str:
    return with_(plan_ctes()) + """
SELECT plan_id, id, store_id, item_id, status, confidence_level, status = 'shorted' AS is_shorted,
       confidence_level = 'low' AS is_low_confidence, len(warning_flags) > 0 AS has_warnings
FROM lines WHERE status = 'shorted' OR confidence_level = 'low' OR len(warning_flags) > 0"""


def q_activity_top() -> str:
    return with_(plan_ctes()) + f"""
SELECT plan_id, rank, id, entity_id, action, changed_at FROM (
  SELECT l.plan_id, a.id, a.entity_id, a.action, a.changed_at,
         ROW_NUMBER() OVER (PARTITION BY l.plan_id ORDER BY a.changed_at DESC, a.id DESC,
                                                           a.action DESC) AS rank
  FROM audit a JOIN lines l ON l.id = a.entity_id WHERE a.entity_type = 'plan_line')
WHERE rank <= {ACTIVITY_LOG_LIMIT}"""


def _accuracy_cte() -> str:
    return """
acc AS (SELECT l.plan_id, l.id, l.store_id, l.item_id, l.recommended_quantity AS predicted,
          o.quantity_ordered AS actual, o.quantity_ordered - l.recommended_quantity AS diff,
          CASE WHEN o.quantity_ordered > 0 THEN abs(o.quantity_ordered - l.recommended_quantity) / o.quantity_ordered * 100
               WHEN o.quantity_ordered IS NOT NULL AND l.recommended_quantity > 0 THEN 100.0 END AS pct_error,
          CASE WHEN o.quantity_ordered IS NULL THEN 'no_actual'
               WHEN abs(o.quantity_ordered - l.recommended_quantity) < 0.01 THEN 'match'
               WHEN o.quantity_ordered - l.recommended_quantity > 0 THEN 'under' ELSE 'over' END AS status,
          l.confidence_level
        FROM lines l JOIN plans p ON p.id = l.plan_id
        LEFT JOIN porders o ON o.store_id = l.store_id AND o.item_id = l.item_id AND o.order_date = p.plan_date)"""


def q_prediction_accuracy() -> str:
    return with_(plan_ctes(), _accuracy_cte()) + f"""
SELECT plan_id, id, store_id, item_id, {r6('predicted')} AS predicted, {r6('actual')} AS actual,
       {r6('diff')} AS diff, {r6('pct_error')} AS pct_error, status, confidence_level FROM acc"""


def q_prediction_summary() -> str:
    return with_(plan_ctes(), _accuracy_cte()) + f"""
SELECT plan_id, COUNT(*) AS total_lines, COUNT(*) FILTER (WHERE status = 'match') AS matched_lines,
       COUNT(*) FILTER (WHERE status = 'over') AS over_predicted,
       COUNT(*) FILTER (WHERE status = 'under') AS under_predicted,
       COUNT(*) FILTER (WHERE status = 'no_actual') AS no_actual,
       {r6('SUM(predicted)')} AS total_predicted_qty, {r6('COALESCE(SUM(actual), 0.0)')} AS total_actual_qty,
       {r6('COALESCE(SUM(abs(diff)), 0.0)')} AS total_abs_error,
       {r6('CASE WHEN COALESCE(SUM(actual), 0.0) > 0 THEN COALESCE(SUM(abs(diff)), 0.0) / SUM(actual) * 100 END')} AS wmape
FROM acc GROUP BY plan_id"""


def q_plan_categories() -> str:
    return with_(plan_ctes()) + """
SELECT DISTINCT l.plan_id, i.category FROM lines l JOIN pitems i ON i.id = l.item_id"""


REPORT_SQL = {
    "pick_list": lambda: _pick_list_sql(),
    "pick_list_search": lambda: _pick_list_sql("STANDARD", "ring"),
    "status_pivot": q_status_pivot,
    "store_breakdown": q_store_breakdown,
    "line_status_apply": q_line_status_apply,
    "line_status_audit": q_line_status_audit,
    "line_status_rejects": q_line_status_rejects,
    "dashboard": q_dashboard,
    "delivery_progress": q_delivery_progress,
    "exceptions": q_exceptions,
    "activity_top": q_activity_top,
    "prediction_accuracy": q_prediction_accuracy,
    "prediction_summary": q_prediction_summary,
    "plan_categories": q_plan_categories,
}


# --------------------------------------------------------------------------
# import validation and upsert (usage rows rendered from lineitem)
# --------------------------------------------------------------------------

def import_ctes(row_notice: int | None = None) -> str:
    over = "false" if row_notice is None else f"line_no - 1 > {row_notice}"
    as_of = f"DATE '{D.IMPORT_AS_OF.isoformat()}'"
    return f"""
raw0 AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS file, l_orderkey * 10 + l_linenumber AS line_key,
                l_partkey, l_suppkey, l_quantity, l_shipdate, l_returnflag FROM lineitem),
raw AS (SELECT file,
          ROW_NUMBER() OVER (PARTITION BY file ORDER BY line_key, l_partkey, l_suppkey, l_quantity,
                                                         l_shipdate, l_returnflag) + 1 AS line_no,
          CASE WHEN line_key % 97 = 1 THEN 'NOPE' WHEN line_key % 97 = 2 THEN '  '
               ELSE 'ST' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') END AS store_code,
          CASE WHEN line_key % 97 = 3 THEN 'P-0' ELSE 'P-' || CAST(l_partkey AS VARCHAR) END AS sku,
          CASE WHEN line_key % 97 = 4 THEN '31/31/2001' WHEN line_key % 97 = 5 THEN '2031-01-01'
               WHEN line_key % 97 % 2 = 0 THEN strftime(l_shipdate, '%-m/%-d/%Y')
               ELSE strftime(l_shipdate, '%Y-%m-%d') END AS usage_date,
          CASE WHEN line_key % 97 = 6 THEN 'NaN' WHEN line_key % 97 = 7 THEN 'inf'
               WHEN line_key % 97 = 8 THEN '-3' WHEN line_key % 97 = 9 THEN '1000000'
               WHEN line_key % 97 = 10 THEN 'abc' ELSE CAST(l_quantity AS VARCHAR) END AS quantity_used,
          CASE WHEN l_returnflag = 'R' THEN ' returned ' END AS notes
        FROM raw0),
istores AS (SELECT s_suppkey AS id, 'ST' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code FROM supplier),
iitems AS (SELECT p_partkey AS id, 'P-' || CAST(p_partkey AS VARCHAR) AS sku FROM part),
chk AS (SELECT r.file, r.line_no, r.notes AS raw_notes, s.id AS store_id, i.id AS item_id,
          CAST(COALESCE(try_strptime(trim(r.usage_date), '%Y-%m-%d'),
                        try_strptime(trim(r.usage_date), '%m/%d/%Y'),
                        try_strptime(trim(r.usage_date), '%m-%d-%Y')) AS DATE) AS date,
          TRY_CAST(trim(r.quantity_used) AS DOUBLE) AS quantity
        FROM raw r
        LEFT JOIN istores s ON upper(trim(s.code)) = upper(trim(r.store_code))
        LEFT JOIN iitems i ON upper(trim(i.sku)) = upper(trim(r.sku))),
chk1 AS (SELECT *,
          CASE WHEN store_id IS NULL THEN 'unknown_store' WHEN item_id IS NULL THEN 'unknown_sku'
               WHEN date IS NULL THEN 'invalid_date' WHEN date > {as_of} THEN 'future_date'
               WHEN NOT (quantity IS NOT NULL AND NOT isnan(quantity) AND abs(quantity) < CAST('inf' AS DOUBLE)
                         AND quantity >= 0 AND quantity <= {CSV_MAX_QUANTITY}) THEN 'invalid_quantity'
          END AS reason, {over} AS over_notice
        FROM chk),
checked AS (SELECT file, line_no,
              CASE WHEN reason IS NULL THEN 'imported' ELSE 'skipped' END AS status,
              reason, store_id, item_id, date, over_notice,
              COALESCE(length(trim(raw_notes)) > 500, false) AS note_too_long,
              CASE WHEN quantity IS NOT NULL AND NOT isnan(quantity) AND abs(quantity) < CAST('inf' AS DOUBLE)
                        AND quantity >= 0 AND quantity <= {CSV_MAX_QUANTITY} THEN quantity END AS quantity,
              CASE WHEN trim(raw_notes) IS NULL OR trim(raw_notes) = '' THEN NULL
                   ELSE trim(raw_notes) END AS notes
            FROM chk1)"""


def q_import_validate(row_notice: int | None = None) -> str:
    return with_(import_ctes(row_notice)) + f"""
SELECT file, line_no, status, reason, store_id, item_id, date, {r6('quantity')} AS quantity, notes,
       over_notice, note_too_long
FROM checked"""


def q_order_import() -> str:
    """Ship years of remainder 1 by 3 are enquiry exports, whose names are looked up first."""
    ok = "quantity IS NOT NULL AND isfinite(quantity) AND quantity >= 0 AND quantity <= 999999"
    return with_(import_ctes()) + f"""
, orow AS (SELECT *, file % 3 = 1 AS enquiry,
             CASE WHEN file % 3 = 1 THEN regexp_replace(store_code, '^ST', 'Supplier#000')
                  ELSE store_code END AS who,
             CASE WHEN line_no % 7 = 0 AND file % 3 = 1 THEN 'Red Widget '
                  ELSE sku END AS what FROM raw),
names AS (SELECT upper(trim(s_name)) AS k, max(s_suppkey) AS id FROM supplier GROUP BY 1),
things AS (SELECT upper(trim(p_name)) AS k, max(p_partkey) AS id FROM part GROUP BY 1),
ochk AS (SELECT r.file, r.line_no,
           CASE WHEN enquiry THEN COALESCE(n.id, s.id) ELSE s.id END AS store_id,
           CASE WHEN enquiry THEN COALESCE(t.id, i.id) ELSE i.id END AS item_id,
           CAST(COALESCE(try_strptime(trim(r.usage_date), '%Y-%m-%d'),
                         try_strptime(trim(r.usage_date), '%m/%d/%Y'),
                         try_strptime(trim(r.usage_date), '%m-%d-%Y')) AS DATE) AS date,
           TRY_CAST(trim(r.quantity_used) AS DOUBLE) AS quantity,
           CASE WHEN r.notes IS NOT NULL AND NOT enquiry
                THEN 'came "back";' || chr(9) || ',' || chr(10) || chr(10) || 'late' END AS notes
         FROM orow r LEFT JOIN names n ON n.k = upper(trim(r.who))
         LEFT JOIN istores s ON upper(trim(s.code)) = upper(trim(r.who))
         LEFT JOIN things t ON t.k = upper(trim(r.what))
         LEFT JOIN iitems i ON upper(trim(i.sku)) = upper(trim(r.what))),
ochk1 AS (SELECT *,
            CASE WHEN store_id IS NULL THEN 'unknown_store' WHEN item_id IS NULL THEN 'unknown_sku'
                 WHEN date IS NULL THEN 'invalid_date' WHEN date > DATE '2002-01-01' THEN 'future_date'
                 WHEN NOT ({ok}) THEN 'invalid_quantity' END AS reason FROM ochk)
SELECT file, line_no, CASE WHEN reason IS NULL THEN 'imported' ELSE 'skipped' END AS status, reason,
       store_id, item_id, date, CASE WHEN {ok} THEN {r6('quantity')} END AS quantity, notes,
       false AS over_notice, false AS note_too_long
FROM ochk1"""


def q_order_file_problems() -> str:
    return """
SELECT CAST(1 AS BIGINT) AS file, CAST(1 AS BIGINT) AS line_no,
       'missing columns: quantity_ordered' AS problem
FROM (SELECT count(*) FROM lineitem)"""


def q_import_summary() -> str:
    return with_(import_ctes(10000)) + """
SELECT file, COUNT(*) FILTER (WHERE status = 'imported') AS imported,
       COUNT(*) FILTER (WHERE status = 'skipped') AS skipped,
       bool_or(over_notice) AS row_limit_exceeded
FROM checked GROUP BY file"""


def q_import_upsert() -> str:
    return with_(import_ctes()) + f"""
, existing AS (SELECT l_suppkey AS store_id, l_partkey AS item_id, CAST(l_shipdate AS DATE) AS usage_date,
                      SUM(l_quantity) AS quantity_used, 'seed' AS source, CAST(NULL AS VARCHAR) AS notes
               FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2, 3),
latest AS (SELECT store_id, item_id, date AS usage_date, quantity AS quantity_used, 'csv_import' AS source, notes
           FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY store_id, item_id, date
                                              ORDER BY file DESC, line_no DESC) AS rn
                 FROM checked WHERE status = 'imported') WHERE rn = 1),
merged AS (SELECT * FROM existing e WHERE NOT EXISTS (
             SELECT 1 FROM latest n WHERE n.store_id = e.store_id AND n.item_id = e.item_id
                                      AND n.usage_date = e.usage_date)
           UNION ALL SELECT * FROM latest)
SELECT store_id, item_id, usage_date, {r6('quantity_used')} AS quantity_used, source, notes FROM merged"""


# --------------------------------------------------------------------------
# dimensions from facts
# --------------------------------------------------------------------------

OBSOLETE_EXAMPLE = ("Brand#25",)
CATEGORY_EXAMPLE = {"Brand#1": "Dairy", "Brand#2": "Coffee", "Brand#3": "Supplies"}


def dim_ctes() -> str:
    obs = ", ".join(f"'{o}'" for o in OBSOLETE_EXAMPLE)
    return f"""
lines AS ({lines_sql('brand')}),
par AS (SELECT DISTINCT store, product,
               CAST(((length(store) + length(product)) % 4) * 10 AS BIGINT) AS max_qty FROM lines),
names AS (SELECT DISTINCT item_name FROM (SELECT product AS item_name FROM lines
                                          UNION ALL SELECT product FROM par)
          WHERE item_name <> '' AND item_name NOT IN ({obs}))"""


def q_item_dimension() -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_EXAMPLE.items())
    return with_(dim_ctes()) + f"""
SELECT item_name,
       upper(regexp_replace(regexp_replace(item_name, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS sku,
       CASE item_name {cases} ELSE 'Other' END AS category, 'each' AS unit_of_measure,
       CAST(1 AS BIGINT) AS case_pack_quantity, 'dry' AS storage_type, true AS active
FROM names"""


def q_settings_from_facts() -> str:
    return with_(dim_ctes()) + """
, pairs AS (SELECT DISTINCT store, product FROM (SELECT store, product FROM lines
                                                 UNION ALL SELECT store, product FROM par))
SELECT p.store, p.product, COALESCE(CAST(par.max_qty AS DOUBLE), 0.0) AS par_level,
       0.0::DOUBLE AS safety_stock, 0.0::DOUBLE AS reorder_threshold, 0.0::DOUBLE AS min_send_quantity,
       'none' AS rounding_rule, true AS active
FROM pairs p LEFT JOIN par ON par.store = p.store AND par.product = p.product"""


def q_par_coverage() -> str:
    return with_(dim_ctes()) + """
SELECT n.item_name, COALESCE(bool_or(par.max_qty > 0), false) AS has_par
FROM names n LEFT JOIN par ON par.product = n.item_name GROUP BY n.item_name"""


def q_quality_summary() -> str:
    def code(cond: str, name: str) -> str:
        return f"CASE WHEN {cond} THEN ['{name}'] ELSE CAST([] AS VARCHAR[]) END"
    codes = ", ".join([
        code("par_level < 0", "negative_par_level"),
        code("safety_stock < 0", "negative_safety_stock"),
        code("reorder_threshold < 0", "negative_reorder_threshold"),
        code("min_send_quantity < 0", "negative_min_send_quantity"),
        code("rounding_rule NOT IN ('round_up_case_pack', 'round_up_integer', 'none')",
             "invalid_rounding_rule"),
        code("usage_window_days IS NOT NULL AND (usage_window_days < 1 OR usage_window_days > 90)",
             "invalid_usage_window"),
        code("d.store_id IS NOT NULL", "duplicate_setting"),
        code("i.id IS NULL", "unknown_item"),
        code("i.id IS NOT NULL AND COALESCE(trim(i.item_name), '') = ''", "blank_item_name"),
        code("i.id IS NOT NULL AND COALESCE(trim(i.sku), '') = ''", "blank_sku"),
        code("c.code IS NOT NULL", "duplicate_sku"),
        code("i.case_pack_quantity < 1", "invalid_case_pack"),
        code("length(i.item_name) > 200", "item_name_too_long"),
        code("length(i.sku) > 50", "sku_too_long")])
    return with_(app_table_ctes()) + f"""
, settings1 AS (SELECT store_id, item_id,
    CASE WHEN item_id % 17 = 1 THEN -1.0 ELSE par_level END AS par_level,
    CASE WHEN item_id % 17 = 2 THEN -1.0 ELSE safety_stock END AS safety_stock,
    CASE WHEN item_id % 17 = 3 THEN -1.0 ELSE 1.0 END AS reorder_threshold,
    CASE WHEN item_id % 17 = 4 THEN -1.0 ELSE min_send_quantity END AS min_send_quantity,
    CASE WHEN item_id % 17 = 5 THEN 'half_up' ELSE rounding_rule END AS rounding_rule,
    CASE WHEN item_id % 17 = 6 THEN 91 WHEN item_id % 17 = 7 THEN 0 ELSE usage_window_days END
      AS usage_window_days FROM settings),
settings2 AS (SELECT * FROM settings1 UNION ALL SELECT * FROM settings1 WHERE item_id % 17 = 8
  UNION ALL SELECT * REPLACE (-item_id - 1 AS item_id) FROM settings1 WHERE item_id % 17 = 9),
items2 AS (SELECT id,
    CASE WHEN id % 17 = 10 THEN repeat('n', 201) WHEN id % 17 = 11 THEN ' ' ELSE item_name END
      AS item_name,
    CASE WHEN id % 17 = 12 THEN repeat(sku, 9) WHEN id % 17 = 13 THEN ''
         WHEN id % 17 = 14 THEN 'sku-shared' ELSE sku END AS sku,
    CASE WHEN id % 17 = 15 THEN 0 ELSE case_pack_quantity END AS case_pack_quantity FROM items),
codes AS (SELECT upper(trim(sku)) AS code FROM items2 WHERE trim(sku) <> ''
          GROUP BY 1 HAVING COUNT(*) > 1),
dup AS (SELECT store_id, item_id FROM settings2 GROUP BY 1, 2 HAVING COUNT(*) > 1),
v AS (SELECT list_concat({codes}) AS codes
      FROM settings2 s LEFT JOIN dup d ON d.store_id = s.store_id AND d.item_id = s.item_id
      LEFT JOIN items2 i ON i.id = s.item_id LEFT JOIN codes c ON c.code = upper(trim(i.sku))),
e AS (SELECT unnest(CASE WHEN len(codes) = 0 THEN ['ok'] ELSE codes END) AS violation FROM v)
SELECT violation, COUNT(*) AS n FROM e GROUP BY violation"""


IMPORT_SQL = {
    "import_validate": q_import_validate,
    "import_validate_capped": lambda: q_import_validate(5000),
    "order_import": q_order_import,
    "order_file_problems": q_order_file_problems,
    "import_summary": q_import_summary,
    "import_upsert": q_import_upsert,
    "item_dimension": q_item_dimension,
    "settings_from_facts": q_settings_from_facts,
    "par_coverage": q_par_coverage,
    "quality_summary": q_quality_summary,
}


def q_top_corrections() -> str:
    return _fb_with() + f"""
SELECT store, product, {r6('factor')} AS factor FROM factors
ORDER BY abs(factor - 1) DESC, store, product LIMIT 10"""


def q_plan_stores() -> str:
    return with_(plan_ctes()) + """
SELECT DISTINCT l.plan_id, s.name AS store_name FROM lines l JOIN pstores s ON s.id = l.store_id"""


def q_packing_v1() -> str:
    return with_(demand_ctes("type"), dow_ctes()) + f"""
, f AS (SELECT h.store, h.product, CASE WHEN t.tot = 0 THEN 0.0 ELSE COALESCE(p.dow_avg, 0.0) * t.trend1 END AS pred
        FROM horizon2 h JOIN trend t ON h.store = t.store AND h.product = t.product
        LEFT JOIN prof1 p ON p.store = h.store AND p.product = h.product AND p.dow = h.dow)
SELECT store, product, {r6('SUM(pred)')} AS total FROM f GROUP BY store, product HAVING SUM(pred) >= 0.5"""


def q_delivery_sheet() -> str:
    return with_(plan_ctes()) + f"""
SELECT l.plan_id, l.store_id, l.id, l.item_id, i.item_name, i.sku, i.category,
       {r6('l.recommended_quantity')} AS recommended_quantity, {r6('l.actual_quantity')} AS actual_quantity,
       l.status, l.confidence_level
FROM lines l JOIN pitems i ON i.id = l.item_id"""


def weight_ctes() -> str:
    """Fixed hold-out rows, and inverse mean absolute errors of all rows and of each series."""
    maes = ", ".join(f"round_even(AVG(abs(actual - pred_{m})), 2) AS {m}, COUNT(pred_{m}) AS n_{m}"
                     for m in ("dow", "exp", "gbt"))
    inverse = {m: f"CASE WHEN n_{m} > 0 THEN 1.0 / GREATEST({m}, 0.001) ELSE 0.0 END"
               for m in ("dow", "exp", "gbt")}
    return f"""
bt AS (SELECT store, product, date, qty AS actual, length(store) <> 6 AS is_daily,
         CASE WHEN length(store) <> 6 THEN qty + k % 5 - 2 END AS pred_dow,
         CASE WHEN length(store) <> 6 AND k % 11 <> 0 THEN qty + (k % 7) * 0.5 - 1 END AS pred_exp,
         CASE WHEN length(store) <> 6 AND length(product) % 3 <> 0 THEN qty + k % 3 - 1.25 END AS pred_gbt
       FROM (SELECT *, day(date) + length(product) AS k FROM daily)),
use AS (SELECT * FROM bt WHERE is_daily AND pred_dow IS NOT NULL AND pred_exp IS NOT NULL),
allm AS (SELECT COUNT(*) AS n, {maes} FROM use),
allw AS (SELECT n, {inverse['dow']} AS w_dow, {inverse['exp']} AS w_exp, n_gbt,
                {inverse['gbt']} AS w_gbt0 FROM allm),
allv AS (SELECT n, w_dow, w_exp,
                CASE WHEN n_gbt > 0 THEN w_gbt0 ELSE GREATEST(w_dow, w_exp) * 1.1 END AS w_gbt FROM allw),
shared AS (SELECT CASE WHEN n = 0 THEN 0.33 ELSE round_even(w_dow / (w_dow + w_exp + w_gbt), 3) END AS dow,
                  CASE WHEN n = 0 THEN 0.34 ELSE round_even(w_exp / (w_dow + w_exp + w_gbt), 3) END AS exp,
                  CASE WHEN n = 0 THEN 0.33 ELSE round_even(w_gbt / (w_dow + w_exp + w_gbt), 3) END AS gbt
           FROM allv),
own AS (SELECT store, product, {maes} FROM use GROUP BY store, product HAVING COUNT(*) >= 7),
ownw AS (SELECT store, product, {inverse['dow']} AS w_dow, {inverse['exp']} AS w_exp, n_gbt,
                {inverse['gbt']} AS w_gbt0 FROM own),
ownv AS (SELECT store, product, w_dow, w_exp,
                CASE WHEN n_gbt > 0 THEN w_gbt0
                     ELSE (SELECT gbt FROM shared) * (w_dow + w_exp) END AS w_gbt FROM ownw)"""


def q_global_weights() -> str:
    return with_(demand_ctes("type"), weight_ctes()) + " SELECT dow, exp, gbt FROM shared"


def q_product_weights() -> str:
    share = ", ".join(f"round_even(w_{m} / (w_dow + w_exp + w_gbt), 3) AS {m}"
                      for m in ("dow", "exp", "gbt"))
    return with_(demand_ctes("type"), weight_ctes()) + f" SELECT store, product, {share} FROM ownv"


def q_packing_order() -> str:
    return f"""
SELECT store, product, total,
       ROW_NUMBER() OVER (PARTITION BY store ORDER BY total DESC, product) AS place
FROM (SELECT DISTINCT store, product, total FROM ({q_packing_list()}))"""


def q_confidence_order() -> str:
    return f"""
SELECT store, product, score, ROW_NUMBER() OVER (ORDER BY score DESC, store, product) AS place
FROM ({q_confidence_score()})"""


def q_accuracy_order() -> str:
    return f"""
SELECT plan_id, id, status, diff,
       ROW_NUMBER() OVER (PARTITION BY plan_id ORDER BY status = 'no_actual', status = 'match',
                          abs(COALESCE(diff, 0.0)) DESC, id) AS place
FROM ({q_prediction_accuracy()})"""


def q_sales_by_date() -> str:
    return with_(f"lines AS ({lines_sql('type')})") + f"""
SELECT store, product, date, {r6('qty')} AS qty,
       ROW_NUMBER() OVER (ORDER BY date, store, product, qty) AS place
FROM (SELECT DISTINCT store, product, date, qty FROM lines)"""


# --------------------------------------------------------------------------
# product configuration as tables
# --------------------------------------------------------------------------

PERIODIC_DELIVERY_WINDOW = 3


def alias_ctes() -> str:
    """Every chain walked name by name; 90 steps pass any chain of 40 and its circle of 3."""
    return """
ali AS (
  SELECT 'Part ' || p_partkey AS variant,
         'Part ' || (CASE WHEN p_partkey % 40 = 1 AND (p_partkey // 40) % 4 = 3
                          THEN p_partkey + 2 ELSE p_partkey - 1 END) AS target
  FROM part WHERE p_partkey % 40 <> 0),
walk AS (
  SELECT variant, target AS step, 1 AS steps FROM ali
  UNION ALL
  SELECT w.variant, a.target, w.steps + 1 FROM walk w JOIN ali a ON a.variant = w.step
  WHERE w.steps < 90),
canon AS (
  SELECT variant, COALESCE(MIN(step) FILTER (WHERE step NOT IN (SELECT variant FROM ali)),
                           MIN(step) FILTER (WHERE steps >= 45)) AS canonical
  FROM walk GROUP BY variant)"""


def q_alias_closure() -> str:
    return "WITH RECURSIVE " + alias_ctes().strip() + "\nSELECT variant, canonical FROM canon"


def q_normalized_demand() -> str:
    return "WITH RECURSIVE " + alias_ctes().strip() + f"""
SELECT l.l_returnflag AS store, COALESCE(c.canonical, 'Part ' || l.l_partkey) AS product,
       CAST(l.l_shipdate AS DATE) AS date, {r6('SUM(l.l_quantity)')} AS qty
FROM lineitem l LEFT JOIN canon c ON c.variant = 'Part ' || l.l_partkey GROUP BY ALL"""


def rule_ctes() -> str:
    return """
rule0 AS (
  SELECT p_partkey AS k, p_type AS product, length(p_type) AS g FROM part
  UNION ALL
  SELECT p_partkey, p_brand, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) FROM part),
rule1 AS (
  SELECT k, product, DATE '1995-01-01' + CAST(k * 37 % 2500 AS INTEGER) AS valid_from,
         CASE WHEN k % 6 = 5 THEN 'seasonal' WHEN g % 4 = 0 THEN 'override'
              WHEN g % 4 = 1 THEN 'periodic' WHEN g % 4 = 2 THEN 'sporadic'
              ELSE 'obsolete' END AS kind
  FROM rule0),
rules AS (
  SELECT product, kind, valid_from,
         CASE WHEN k % 11 <> 0 THEN valid_from + CAST(k * 13 % 400 - 20 AS INTEGER) END AS valid_to,
         CASE WHEN kind = 'override' THEN CASE k % 5 WHEN 0 THEN 'daily' WHEN 1 THEN 'periodic'
              WHEN 2 THEN 'intermittent' WHEN 3 THEN 'dormant' ELSE 'weekly' END END AS lane
  FROM rule1)"""


def live_rule_ctes() -> str:
    return rule_ctes() + """,
live AS (
  SELECT product, kind, lane, valid_from FROM rules, bounds
  WHERE kind <> 'seasonal' AND (kind <> 'override' OR lane <> 'weekly')
    AND valid_from <= d1 AND (valid_to IS NULL OR valid_to >= d1)),
force AS (
  SELECT l.product,
         (SELECT o.lane FROM live o WHERE o.product = l.product AND o.kind = 'override'
          ORDER BY o.valid_from DESC, o.lane LIMIT 1) AS lane_override,
         bool_or(kind = 'periodic') AS periodic, bool_or(kind = 'sporadic') AS sporadic,
         bool_or(kind = 'obsolete') AS obsolete
  FROM live l GROUP BY l.product)"""


def ruled_lane_ctes() -> str:
    """``lanes2`` with the rules in force."""
    return lane_ctes().replace("lanes2 AS", "lanes_plain AS") + """,
lanes2 AS (
  SELECT l.* REPLACE (CASE WHEN f.lane_override IS NOT NULL THEN f.lane_override
                           WHEN l.lane = 'daily' AND f.periodic THEN 'periodic'
                           ELSE l.lane END AS lane),
         CASE WHEN n_order_days = 0 THEN 0.0
              ELSE GREATEST(0.0, (window_nonzero_qty / n_order_days)
                                 / GREATEST(n_days / n_order_days, """ + f"{PERIODIC_DELIVERY_WINDOW}" + """)) END
           AS periodic_rate
  FROM lanes_plain l LEFT JOIN force f ON f.product = l.product)"""


def q_rules_in_force() -> str:
    return with_(demand_ctes("brand"), live_rule_ctes()) + """
SELECT product, lane_override, periodic, sporadic, obsolete FROM force"""


def q_rule_problems() -> str:
    return with_(rule_ctes()) + """
SELECT CASE WHEN kind = 'seasonal' THEN 'unknown_kind' WHEN kind = 'override' AND lane = 'weekly'
            THEN 'unknown_lane' ELSE 'ends_before_start' END AS problem, COUNT(*) AS n
FROM rules WHERE kind = 'seasonal' OR (kind = 'override' AND lane = 'weekly') OR valid_to < valid_from
GROUP BY 1"""


def q_lane_rules() -> str:
    rate = ("CASE lane WHEN 'intermittent' THEN intermittent_rate WHEN 'periodic' THEN periodic_rate "
            "ELSE 0.0 END")
    return with_(demand_ctes("type"), live_rule_ctes(), ruled_lane_ctes()) + f"""
SELECT store, product, n_days, n_order_days, lane, {r6(rate)} AS lane_rate FROM lanes2"""


def q_lane_rules_forecast() -> str:
    packing = packing_ctes().replace(
        "WHEN l.lane = 'intermittent' THEN l.intermittent_rate",
        "WHEN l.lane = 'intermittent' THEN l.intermittent_rate "
        "WHEN l.lane = 'periodic' THEN l.periodic_rate")
    few = ", ".join(f"'{p}'" for p in SPORADIC_EXAMPLE)
    packing = packing.replace(f"product IN ({few})",
                              "product IN (SELECT product FROM force WHERE sporadic)")
    return with_(demand_ctes("brand"), live_rule_ctes(), ruled_lane_ctes(), dow_ctes(), packing) + f"""
SELECT store, product, lane, day_idx, date, {r6('pred')} AS pred FROM safe"""


EXTRA_SQL = {
    "alias_closure": q_alias_closure,
    "normalized_demand": q_normalized_demand,
    "rules_in_force": q_rules_in_force,
    "rule_problems": q_rule_problems,
    "lane_rules": q_lane_rules,
    "lane_rules_forecast": q_lane_rules_forecast,
    "confidence_order": q_confidence_order,
    "accuracy_order": q_accuracy_order,
    "sales_by_date": q_sales_by_date,
    "global_weights": q_global_weights,
    "product_weights": q_product_weights,
    "packing_order": q_packing_order,
    "delivery_sheet": q_delivery_sheet,
    "top_corrections": q_top_corrections,
    "plan_stores": q_plan_stores,
    "packing_v1": q_packing_v1,
}
