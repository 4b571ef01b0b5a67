"""The same results in DuckDB SQL, written from the definitions and not from the Spark plans:
full grids, self joins and plain windows where the operators avoid them."""

from __future__ import annotations

from ebbtide.suite.queries import (
    ACTION_RULES,
    BUDGET,
    BURST,
    HOLDOUT_PCT,
    PROBS,
    SALT,
    SEGMENT_RULES,
)


def _r(x: str, digits: int = 6) -> str:
    return f"(round(({x})::DOUBLE, {digits}) + 0::DOUBLE)"


def _values(rows: list[tuple]) -> str:
    def one(v):
        return "NULL" if v is None else repr(v)

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


CUT, SNAP, UNTIL = "DATE '2000-08-01'", "DATE '2001-08-01'", "DATE '2001-06-30'"
LAST_Q = 2001 * 4 + 1
WM = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"

FACTS = """facts AS (SELECT o_custkey AS k, o_orderdate::DATE AS d, o_totalprice AS amount,
  (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::BIGINT AS q FROM orders)"""
DAYS = f"""{FACTS}, days AS (SELECT k, d, count(*) AS n_orders, sum(amount) AS amount
  FROM facts GROUP BY k, d)"""
GAPS = f"""{DAYS}, lagged AS (SELECT k, d, lag(d) OVER (PARTITION BY k ORDER BY d) AS prev FROM days),
  gaps AS (SELECT *, (d - prev)::BIGINT AS gap FROM lagged WHERE prev IS NOT NULL)"""
LABEL = f"""{FACTS}, label AS (SELECT p.k, (CASE WHEN EXISTS (SELECT 1 FROM facts f WHERE f.k = p.k
  AND f.d >= {CUT} AND f.d < {CUT} + 365) THEN 0 ELSE 1 END)::BIGINT AS churned
  FROM (SELECT DISTINCT k FROM facts WHERE d >= {CUT} - 365 AND d < {CUT}) p)"""
DIMS = """dims AS (SELECT c_custkey AS k, c_mktsegment AS segment, n_name AS nation,
  r_name AS region, c_acctbal AS balance FROM customer
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""
STATUS = f"""{FACTS}, firsts AS (SELECT k, min(q) AS f FROM facts GROUP BY k),
  spine AS (SELECT k, unnest(range(f, {LAST_Q} + 1)) AS q FROM firsts WHERE f <= {LAST_Q}),
  act AS (SELECT DISTINCT k, q FROM facts),
  marked AS (SELECT s.k, s.q, a.q IS NOT NULL AS on_now FROM spine s
    LEFT JOIN act a ON a.k = s.k AND a.q = s.q),
  seen AS (SELECT *, lag(on_now) OVER (PARTITION BY k ORDER BY q) AS on_before FROM marked),
  status AS (SELECT k, q, CASE WHEN on_before IS NULL THEN 'new'
    WHEN on_now AND on_before THEN 'retained' WHEN on_now THEN 'resurrected'
    WHEN on_before THEN 'churned' ELSE 'dormant' END AS status FROM seen)"""
SPELLS = f"""{DAYS}, led AS (SELECT k, d, lead(d) OVER (PARTITION BY k ORDER BY d) AS nx FROM days
    WHERE d <= {SNAP}),
  spells AS (SELECT k, d AS start, (coalesce(nx, {SNAP}) - d)::BIGINT AS dur,
    (nx IS NOT NULL)::BIGINT AS event FROM led)"""
RISK = f"""{FACTS}, risk AS (SELECT k, ({CUT} - max(d)) / 365.0::DOUBLE AS risk FROM facts
  WHERE d >= {CUT} - 365 AND d < {CUT} GROUP BY k)"""
VALUED = f"""{RISK}, valued AS (SELECT r.k, r.risk, sum(f.amount) AS value,
  r.risk * sum(f.amount) AS at_risk FROM risk r JOIN facts f ON f.k = r.k
  AND f.d >= {CUT} - 365 AND f.d < {CUT} GROUP BY r.k, r.risk)"""
RULES = f"""rules(rule_id, risk_lo, risk_hi, value_lo, value_hi, action, cost) AS
  (VALUES {_values(ACTION_RULES)})"""
ASSIGNED = f"""{VALUED}, {RULES}, assigned AS (SELECT v.*, r.rule_id::BIGINT AS rule_id, r.action,
  r.cost::DOUBLE AS cost FROM valued v LEFT JOIN rules r ON v.risk >= coalesce(r.risk_lo, -1e300)
  AND v.risk < coalesce(r.risk_hi, 1e300) AND v.value >= coalesce(r.value_lo, -1e300)
  AND v.value < coalesce(r.value_hi, 1e300))"""
RFM = f"""{FACTS}, c AS (SELECT k, ({SNAP} - max(d))::BIGINT AS recency, count(*) AS frequency,
    round(sum(amount), 2) AS monetary FROM facts WHERE d <= {SNAP} GROUP BY k),
  long AS (SELECT 'r' AS m, recency::DOUBLE AS x FROM c UNION ALL
    SELECT 'f', frequency FROM c UNION ALL SELECT 'm', monetary FROM c),
  rk AS (SELECT m, x, row_number() OVER (PARTITION BY m ORDER BY x) AS rn,
    count(*) OVER (PARTITION BY m) AS n FROM long),
  cuts AS (SELECT m, x FROM rk, range(1, 5) t(i) WHERE rn = greatest(1, ceil(n * i / 5.0))),
  rfm AS (SELECT c.*,
    5 - (SELECT count(*) FROM cuts WHERE m = 'r' AND x < recency) AS r,
    1 + (SELECT count(*) FROM cuts WHERE m = 'f' AND x < frequency) AS f,
    1 + (SELECT count(*) FROM cuts WHERE m = 'm' AND x < monetary) AS m FROM c)"""
HOLDOUT = f"""holdout AS (SELECT c_custkey AS k, CASE WHEN
  ('0x' || substr(md5('{SALT}:' || c_custkey::VARCHAR), 1, 8))::BIGINT % 100 < {HOLDOUT_PCT}
  THEN 'control' ELSE 'treated' END AS arm FROM customer)"""


def _window_features(w: int) -> str:
    inside = f"d >= {CUT} - {w}"
    return f"""coalesce(sum(n) FILTER ({inside}), 0)::BIGINT AS orders_{w},
      coalesce(sum(amount) FILTER ({inside}), 0) AS spend_{w}, avg(gap_{w}) AS mean_gap_{w}"""


# Gaps are taken between neighbours inside each window, then averaged.
_gap_columns = ", ".join(
    f"d - lag(CASE WHEN d >= {CUT} - {w} THEN d END) OVER (PARTITION BY k ORDER BY d) AS gap_{w}"
    for w in (90, 180, 365)
)
FEATURES = f"""{DIMS}, fd AS (SELECT o_custkey AS k, o_orderdate::DATE AS d, count(*) AS n,
    sum(o_totalprice) AS amount, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent
    FROM orders WHERE o_orderdate >= {CUT} - 365 AND o_orderdate < {CUT} GROUP BY ALL),
  fg AS (SELECT *, {_gap_columns} FROM fd),
  features AS (SELECT k, ({CUT} - max(d))::BIGINT AS days_since,
    {_window_features(90)}, {_window_features(180)}, {_window_features(365)},
    sum(urgent) / sum(n) AS urgent_share, any_value(balance) AS balance,
    any_value(segment) AS segment, any_value(region) AS region
    FROM fg LEFT JOIN dims USING (k) GROUP BY k)"""
NUMERIC = ["days_since"] + [
    f"{p}_{w}" for w in (90, 180, 365) for p in ("orders", "spend", "mean_gap")
] + ["urgent_share", "balance"]

SESSIONS = """lagged AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p
    FROM events),
  numbered AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM lagged),
  sessions AS (SELECT user_id, min(ts) AS b, max(ts) AS e, count(*) AS events FROM numbered
    GROUP BY user_id, s)"""
ALERTS = f"""led AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx
    FROM events),
  alerts AS (SELECT user_id, event_id AS last_event_id, event_type AS last_type,
    ts::VARCHAR AS quiet_from, (ts + INTERVAL 24 HOUR)::VARCHAR AS alert_at FROM led
    WHERE (nx IS NULL OR nx >= ts + INTERVAL 24 HOUR) AND ts + INTERVAL 24 HOUR <= {WM})"""


FUNNEL = """s AS (SELECT user_id, event_type AS t, ts FROM events
        WHERE event_type IN ('view', 'click', 'purchase')),
      p2 AS (SELECT DISTINCT a.user_id, a.ts AS t1, b.ts AS t2 FROM s a JOIN s b USING (user_id)
        WHERE a.t = 'view' AND b.t = 'click' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR),
      p3 AS (SELECT DISTINCT p2.user_id FROM p2 JOIN s c USING (user_id)
        WHERE c.t = 'purchase' AND c.ts > t2 AND c.ts <= t1 + INTERVAL 24 HOUR)
      SELECT user_id, (CASE WHEN user_id IN (SELECT user_id FROM p3) THEN 3
        WHEN user_id IN (SELECT user_id FROM p2) THEN 2 WHEN bool_or(t = 'view') THEN 1
        ELSE 0 END)::BIGINT AS furthest FROM s GROUP BY user_id"""
ROLLING = """SELECT event_id, user_id, ts::VARCHAR AS ts,
      count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts
        RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS errors FROM events"""
HOT = f"""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN date_trunc('day', ts)
    WHEN event_id % 5 = 0 THEN TIMESTAMP '{BURST}' + (event_id % 600) * INTERVAL 1 SECOND
    ELSE ts END::TIMESTAMP AS ts, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id,
    event_type, value, props FROM main.events"""
TRAIN = LABEL.replace("2000-08-01", "1999-08-01")


def _feature(c: str) -> str:
    if c.startswith(("days", "orders")):
        return c
    return f"{_r(c, 2 if c.startswith(('spend', 'balance')) else 6)} AS {c}"


def _rate(by: str, grouping: str, level: str) -> str:
    return f"""WITH {LABEL}, {DIMS} SELECT {by}, ({level})::BIGINT AS level,
      count(*) AS customers, sum(churned)::BIGINT AS churned,
      {_r("avg(churned)")} AS rate FROM label LEFT JOIN dims USING (k) GROUP BY {grouping}"""


def _survival(strata: str, source: str) -> str:
    same = "AND s.segment = t.segment" if strata else ""
    part = f"PARTITION BY {strata}" if strata else ""
    pick = f"{strata}," if strata else ""
    return f"""WITH {SPELLS}, {source},
      t AS (SELECT {pick} dur AS t, sum(event)::BIGINT AS events FROM src GROUP BY ALL
        HAVING sum(event) > 0),
      risk AS (SELECT t.*, (SELECT count(*) FROM src s WHERE s.dur >= t.t {same}) AS at_risk FROM t)
      SELECT {pick} t, at_risk, events, {_r(f'''CASE WHEN bool_or(events = at_risk) OVER w THEN 0
        ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk::DOUBLE) END) OVER w)
        END''')} AS survival FROM risk WINDOW w AS ({part} ORDER BY t)"""


def _relation(parent: str, pk: str, child: str, fk: str) -> str:
    return f"""SELECT '{child}.{fk}->{parent}.{pk}' AS relation,
      (SELECT count(*) - count(DISTINCT {pk}) FROM {parent}) AS duplicate_keys,
      (SELECT count(*) FROM {child} WHERE {fk} NOT IN (SELECT {pk} FROM {parent})) AS orphans,
      (SELECT count(DISTINCT {pk}) FROM {parent}
        WHERE {pk} NOT IN (SELECT {fk} FROM {child})) AS childless"""


def _contrast(feature: str) -> str:
    return f"""SELECT '{feature}' AS feature, avg({feature}) FILTER (churned = 1) AS m1,
      avg({feature}) FILTER (churned = 0) AS m0, count({feature}) FILTER (churned = 1) AS n1,
      count({feature}) FILTER (churned = 0) AS n0,
      var_samp({feature}) FILTER (churned = 1) AS v1,
      var_samp({feature}) FILTER (churned = 0) AS v0 FROM judged"""


def _lift(dimension: str) -> str:
    return f"""SELECT '{dimension}' AS dimension, {dimension} AS category, count(*) AS n,
      sum(churned) AS c, count(*) - sum(churned) AS s FROM label LEFT JOIN dims USING (k)
      GROUP BY {dimension}"""


def _activity(days: int) -> str:
    back = ", ".join(f"({i})" for i in range(days))
    return f"""SELECT w::VARCHAR AS window_start, (w + INTERVAL {days} DAY)::VARCHAR AS window_end,
      event_type, count(*) AS events, {_r("sum(value)", 2)} AS total
      FROM (SELECT date_trunc('day', ts)::TIMESTAMP - to_days(i) AS w, event_type, value
        FROM events, (VALUES {back}) t(i))
      WHERE w + INTERVAL {days} DAY <= {WM} GROUP BY ALL"""


ORACLE: dict[str, str] = {
    "load": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}"
        for t in ("region", "nation", "customer", "orders", "lineitem", "events")
    ),
    "order_days": f"WITH {DAYS} SELECT k, d::VARCHAR AS d, n_orders, {_r('amount', 2)} AS amount FROM days",
    "integrity_report": " UNION ALL ".join(
        _relation(*r)
        for r in (
            ("region", "r_regionkey", "nation", "n_regionkey"),
            ("nation", "n_nationkey", "customer", "c_nationkey"),
            ("customer", "c_custkey", "orders", "o_custkey"),
            ("orders", "o_orderkey", "lineitem", "l_orderkey"),
            ("customer", "c_custkey", "events", "user_id"),
        )
    ),
    "period_spine": f"WITH {STATUS} SELECT k, q FROM spine",
    "write_result": f"""WITH {DAYS} SELECT k, d::VARCHAR AS d, n_orders, {_r('amount', 2)} AS amount,
      year(d)::BIGINT AS year FROM days""",
    "purchase_gaps": f"WITH {GAPS} SELECT k, d::VARCHAR AS d, prev::VARCHAR AS prev, gap FROM gaps",
    "gap_quantiles": f"WITH {GAPS} "
    + " UNION ALL ".join(
        f"SELECT {p}::DOUBLE AS prob, {_r(f'quantile_cont(gap, {p})')} AS gap FROM gaps"
        for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
    ),
    "recency_state": f"""WITH {FACTS}, l AS (SELECT k, max(d) AS m FROM facts WHERE d <= {CUT} GROUP BY k)
      SELECT k, m::VARCHAR AS last_d, ({CUT} - m)::BIGINT AS days_since,
      CASE WHEN {CUT} - m > 180 THEN 'lapsed' ELSE 'active' END AS state FROM l""",
    "churn_label": f"WITH {LABEL} SELECT k, churned FROM label",
    "churn_rate": _rate("region, segment", "region, segment", "0"),
    "churn_rate_rollup": _rate(
        "region, nation, segment", "ROLLUP (region, nation, segment)", "grouping(region, nation, segment)"
    ),
    "churn_rate_cube": _rate("region, segment", "CUBE (region, segment)", "grouping(region, segment)"),
    "period_status": f"WITH {STATUS} SELECT k, q, status FROM status",
    "growth_accounting": f"""WITH {STATUS}, g AS (SELECT q, count(*) FILTER (status = 'new') AS new,
        count(*) FILTER (status = 'retained') AS retained,
        count(*) FILTER (status = 'resurrected') AS resurrected,
        count(*) FILTER (status = 'churned') AS churned,
        count(*) FILTER (status = 'dormant') AS dormant,
        count(*) FILTER (status IN ('new', 'retained', 'resurrected')) AS active
        FROM status GROUP BY q)
      SELECT g.*, {_r("g.churned / nullif(b.active, 0)::DOUBLE")} AS churn_rate
      FROM g LEFT JOIN g b ON b.q = g.q - 1""",
    "cohort_retention": f"""WITH {STATUS}, sized AS (SELECT f AS cohort, count(*) AS customers
        FROM firsts WHERE f <= {LAST_Q} GROUP BY f),
      grid AS (SELECT cohort, customers, unnest(range({LAST_Q} - cohort + 1)) AS since FROM sized),
      hits AS (SELECT f AS cohort, q - f AS since, count(*) AS n FROM act JOIN firsts USING (k)
        GROUP BY ALL)
      SELECT cohort, since::BIGINT AS since, customers, coalesce(n, 0) AS retained,
      {_r("coalesce(n, 0) / customers::DOUBLE")} AS rate FROM grid LEFT JOIN hits USING (cohort, since)""",
    "spells": f"WITH {SPELLS} SELECT k, start::VARCHAR AS start, dur, event FROM spells",
    "survival_curve": _survival("", "src AS (SELECT * FROM spells)"),
    "survival_curve_by_segment": _survival(
        "segment", f"{DIMS}, src AS (SELECT spells.*, segment FROM spells JOIN dims USING (k))"
    ),
    "last_orders": f"""WITH {DAYS}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC)
      AS rank FROM days) SELECT k, d::VARCHAR AS d, n_orders, {_r('amount', 2)} AS amount, rank
      FROM n WHERE rank <= 3""",
    "rfm": f"""WITH {RFM} SELECT k, recency, frequency, {_r('monetary')} AS monetary, r, f, m FROM rfm""",
    "rfm_segment": f"""WITH {RFM}, rules(segment, priority, r_lo, r_hi, f_lo, f_hi, m_lo, m_hi) AS
        (VALUES {_values(SEGMENT_RULES)})
      SELECT r, f, m, k, recency, frequency, {_r('monetary')} AS monetary,
      (SELECT segment FROM rules WHERE r BETWEEN r_lo AND r_hi AND f BETWEEN f_lo AND f_hi
        AND m BETWEEN m_lo AND m_hi ORDER BY priority LIMIT 1) AS segment FROM rfm""",
    "features": f"WITH {FEATURES} SELECT k, segment, region, "
    + ", ".join(_feature(c) for c in NUMERIC)
    + " FROM features",
    "return_share": f"""WITH o AS (SELECT o_orderkey, o_custkey AS k FROM orders WHERE o_orderdate < {CUT})
      SELECT k, count(l_orderkey) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned,
      {_r("avg(CASE WHEN l_orderkey IS NOT NULL THEN (l_returnflag = 'R')::INT END)")} AS share
      FROM o LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY k""",
    "spend_trend": f"""WITH {FACTS}, w AS (SELECT 2000 * 4 + 1 AS last),
      f AS (SELECT k, greatest(min(q), last - 7) AS f FROM facts, w WHERE q <= last GROUP BY k, last),
      grid AS (SELECT k, unnest(range(f, last + 1)) AS q FROM f, w),
      spend AS (SELECT k, q, sum(amount) AS y FROM facts GROUP BY k, q)
      SELECT k, count(*) AS quarters, {_r('''CASE WHEN count(*) > 1
        THEN regr_slope(coalesce(y, 0), q) END''', 4)} AS slope
      FROM grid LEFT JOIN spend USING (k, q) GROUP BY k""",
    "driver_contrast": f"""WITH {LABEL}, {FEATURES},
      judged AS (SELECT * FROM features JOIN label USING (k)),
      c AS ({" UNION ALL ".join(_contrast(f) for f in NUMERIC)})
      SELECT feature, {_r('m1', 4)} AS mean_churned, {_r('m0', 4)} AS mean_stayed,
      {_r('m1 - m0', 4)} AS difference,
      {_r('(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2))', 4)} AS cohens_d FROM c""",
    "category_lift": f"""WITH {LABEL}, {DIMS},
      c AS ({_lift('segment')} UNION ALL {_lift('region')} UNION ALL {_lift('nation')}),
      t AS (SELECT dimension, sum(n) AS tn, sum(c) AS tc, sum(c + 0.5) AS pc, sum(s + 0.5) AS ps
        FROM c GROUP BY dimension),
      e AS (SELECT c.*, t.tn, t.tc, ((c.c + 0.5) / t.pc)::DOUBLE AS a, ((s + 0.5) / t.ps)::DOUBLE AS b
        FROM c JOIN t USING (dimension))
      SELECT dimension, category, n AS customers, c::BIGINT AS churned, {_r('c / n::DOUBLE')} AS rate,
      {_r('(c / n::DOUBLE) / (tc / tn::DOUBLE)')} AS lift, {_r('ln(a / b)')} AS woe,
      {_r('sum((a - b) * ln(a / b)) OVER (PARTITION BY dimension)')} AS information_value FROM e""",
    "feature_correlation": f"""WITH {FEATURES} """
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_r(f'corr({a}, {b})')} AS correlation FROM features"
        for i, a in enumerate(NUMERIC)
        for b in NUMERIC[i + 1 :]
    ),
    "lift_table": f"""WITH {RISK}, {LABEL.replace(FACTS + ', ', '')},
      rk AS (SELECT risk, row_number() OVER (ORDER BY risk) AS rn, count(*) OVER () AS n FROM risk),
      cuts AS (SELECT risk AS x FROM rk, range(1, 10) t(i) WHERE rn = ceil(n * i / 10.0)),
      b AS (SELECT 1 + (SELECT count(*) FROM cuts WHERE x < risk) AS band, churned
        FROM risk JOIN label USING (k)),
      g AS (SELECT band, count(*) AS customers, sum(churned)::BIGINT AS churned FROM b GROUP BY band)
      SELECT band, customers, churned, {_r('churned / customers::DOUBLE')} AS rate,
      {_r('sum(churned) OVER (ORDER BY band DESC) / sum(churned) OVER ()')} AS capture FROM g""",
    "auc": f"""WITH {RISK}, {LABEL.replace(FACTS + ', ', '')}, j AS (SELECT * FROM risk JOIN label USING (k)),
      p AS (SELECT count(*) AS pairs, sum(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk
        THEN 0.5 ELSE 0 END) AS wins FROM j a JOIN j b ON a.churned = 1 AND b.churned = 0)
      SELECT (SELECT count(*) FROM j) AS customers, (SELECT sum(churned)::BIGINT FROM j) AS churned,
      {_r('wins / pairs')} AS auc FROM p""",
    "value_scores": f"""WITH {VALUED} SELECT k, {_r('risk')} AS risk, {_r('value', 2)} AS value,
      {_r('at_risk', 2)} AS at_risk FROM valued""",
    "value_at_risk": f"""WITH {VALUED}, {DIMS} SELECT region, segment, count(*) AS customers,
      {_r('sum(value)', 2)} AS value, {_r('sum(at_risk)', 2)} AS at_risk
      FROM valued LEFT JOIN dims USING (k) GROUP BY region, segment""",
    "assign_action": f"""WITH {ASSIGNED} SELECT k, {_r('risk')} AS risk, {_r('value', 2)} AS value,
      {_r('at_risk', 2)} AS at_risk, rule_id, action, {_r('cost')} AS cost FROM assigned""",
    "check_rules": f"""WITH {VALUED}, m AS (SELECT c_nationkey::BIGINT AS id, round(avg(risk), 4) AS r,
        round(avg(value), 2) AS v FROM valued JOIN customer ON c_custkey = k GROUP BY c_nationkey),
      b AS (SELECT id, r - 0.01 AS r1, r + 0.01 AS r2, v * 0.98 AS v1, v * 1.02 AS v2 FROM m)
      SELECT x.id AS rule_a, y.id AS rule_b FROM b x JOIN b y ON x.id < y.id
      AND x.r1 < y.r2 AND y.r1 < x.r2 AND x.v1 < y.v2 AND y.v1 < x.v2""",
    "top_targets": f"""WITH {VALUED}, {DIMS}, n AS (SELECT region, k, at_risk,
      row_number() OVER (PARTITION BY region ORDER BY at_risk DESC, k) AS rank
      FROM valued LEFT JOIN dims USING (k))
      SELECT region, k, {_r('at_risk', 2)} AS at_risk, rank FROM n WHERE rank <= 20""",
    "budget_list": f"""WITH {ASSIGNED}, s AS (SELECT k, at_risk, cost,
      sum(cost) OVER (ORDER BY at_risk DESC, k ROWS UNBOUNDED PRECEDING) AS spent
      FROM assigned WHERE cost IS NOT NULL)
      SELECT k, {_r('at_risk', 2)} AS priority, {_r('cost')} AS cost, {_r('spent')} AS spent
      FROM s WHERE spent <= {BUDGET}""",
    "holdout": f"WITH {HOLDOUT} SELECT k, arm FROM holdout",
    "experiment_readout": f"""WITH {LABEL}, {HOLDOUT}, j AS (SELECT * FROM holdout JOIN label USING (k)),
      a AS (SELECT count(*) FILTER (arm = 'treated') AS n1,
        count(*) FILTER (arm = 'treated' AND churned = 1) AS c1,
        count(*) FILTER (arm = 'control') AS n0,
        count(*) FILTER (arm = 'control' AND churned = 1) AS c0 FROM j),
      p AS (SELECT *, c1 / n1::DOUBLE AS p1, c0 / n0::DOUBLE AS p0,
        (c1 + c0) / (n1 + n0)::DOUBLE AS p FROM a),
      e AS (SELECT *, p1 - p0 AS d, 1.959963984540054 * sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
        AS h FROM p)
      SELECT n1 AS treated_n, c1 AS treated_churned, n0 AS control_n, c0 AS control_churned,
      {_r('p1')} AS treated_rate, {_r('p0')} AS control_rate, {_r('d')} AS difference,
      {_r('d - h')} AS low, {_r('d + h')} AS high,
      {_r('d / sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / n0))')} AS z FROM e""",
    "sessions": f"""WITH {SESSIONS} SELECT user_id, b::VARCHAR AS session_start,
      e::VARCHAR AS session_end, events FROM sessions""",
    "funnel": "WITH " + FUNNEL,
    "event_retention": """WITH f AS (SELECT user_id, min(ts)::DATE AS f FROM events GROUP BY user_id),
      n(day_n) AS (VALUES (1), (3), (7), (14), (28)),
      g AS (SELECT day_n, f.user_id, EXISTS (SELECT 1 FROM events e WHERE e.user_id = f.user_id
          AND e.ts::DATE = f.f + day_n) AS back FROM f, n WHERE f.f + day_n <= DATE '2024-01-30')
      SELECT day_n::BIGINT AS day_n, count(*) AS users, count(*) FILTER (back) AS returned,
      """
    + _r("count(*) FILTER (back) / count(*)::DOUBLE")
    + " AS rate FROM g GROUP BY day_n",
    "quiet_periods": f"""WITH led AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
      AS nx FROM events) SELECT user_id, event_id AS last_event_id, event_type AS last_type,
      ts::VARCHAR AS quiet_from, nx::VARCHAR AS quiet_until,
      {_r("(epoch_us(nx) - epoch_us(ts)) / 1e6")} AS wait_seconds
      FROM led WHERE nx - ts >= INTERVAL 24 HOUR""",
    "rolling_errors": ROLLING,
    "last_before": f"""SELECT e.event_id, e.user_id, e.ts::VARCHAR AS ts, p.ts::VARCHAR AS last_ts,
      {_r('p.value', 2)} AS last_value FROM events e ASOF LEFT JOIN
      (SELECT * FROM events WHERE event_type = 'purchase') p
      ON e.user_id = p.user_id AND e.ts > p.ts""",
    "funnel_hot": f"WITH events AS ({HOT}), " + FUNNEL,
    "rolling_errors_hot": f"WITH events AS ({HOT}) " + ROLLING,
    "last_before_hot": f"""WITH events AS ({HOT}),
      m AS (SELECT e.event_id, max(struct_pack(ts := p.ts, id := p.event_id, v := p.value)) AS found
        FROM events e JOIN events p ON e.user_id = p.user_id AND p.ts < e.ts
        WHERE p.event_type = 'purchase' GROUP BY e.event_id)
      SELECT e.event_id, e.user_id, e.ts::VARCHAR AS ts, found.ts::VARCHAR AS last_ts,
      {_r('found.v', 2)} AS last_value FROM events e LEFT JOIN m USING (event_id)""",
    "fit_churn_model": f"""WITH {TRAIN} SELECT count(*) AS customers, sum(churned)::BIGINT AS churned,
      {_r('round(sum(churned) / count(*)::DOUBLE, 3)')} AS mean_risk FROM label""",
    "score": f"WITH {FEATURES} SELECT k, TRUE AS valid FROM features",
    "auc_model": f"""WITH {LABEL} SELECT count(*) AS customers, sum(churned)::BIGINT AS churned,
      TRUE AS agrees FROM label""",
    "gap_quantiles_approx": f"SELECT unnest({list(PROBS)})::DOUBLE AS prob, TRUE AS close",
    "stream_activity": _activity(1),
    "stream_activity_sliding": _activity(2),
    "stream_sessions": f"""WITH {SESSIONS} SELECT user_id, b::VARCHAR AS session_start,
      e::VARCHAR AS session_end, events FROM sessions WHERE e + INTERVAL 6 HOUR <= {WM}""",
    "stream_dedup": f"""SELECT event_id, ts::VARCHAR AS ts, user_id, event_type,
      {_r('value')} AS value, props FROM events""",
    "stream_idle_alerts": f"WITH {ALERTS} SELECT * FROM alerts",
    "stream_enrich": f"""WITH {ALERTS}, {DIMS} SELECT alerts.*, segment, nation, region
      FROM alerts LEFT JOIN dims ON k = user_id""",
}
