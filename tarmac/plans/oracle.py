"""DuckDB SQL equivalents of the catalog queries (the correctness oracle).

Every query starts from the same CTE chain: the fixture view of FIXTURES.md
(``traffic``), the pre-2020 baselines, the quartile edges and the prepared
feature rows (``feat``).  Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from ..functions.phases import PHASE_ORDER
from ..sources.dims import REQUEST_DATES, UNKNOWN_AIRPORT_PREFIX
from ..sources.schema import NUMERICAL_FEATURES
from .params import CORRELATION_FEATURES, EMPTY_RANGE, END, REF_END, REF_START, SPLIT, START, TWO_FEATURES


def _phase_case(year: str = "YEAR", month: str = "MONTH_NUM") -> str:
    p = [f"'{x}'" for x in PHASE_ORDER]
    return f"""CASE WHEN {year} < 2020 THEN {p[0]}
      WHEN {year} = 2020 AND {month} BETWEEN 3 AND 5 THEN {p[1]}
      WHEN {year} = 2020 AND {month} BETWEEN 6 AND 8 THEN {p[2]}
      WHEN {year} = 2020 THEN {p[3]}
      WHEN {year} = 2021 AND {month} BETWEEN 1 AND 4 THEN {p[4]}
      WHEN {year} = 2021 AND {month} BETWEEN 5 AND 8 THEN {p[5]}
      WHEN {year} = 2021 THEN {p[6]}
      WHEN {year} = 2022 THEN {p[7]}
      WHEN {year} >= 2023 THEN {p[8]}
      ELSE 'Other' END"""


CLOSED_FORM = ["Monthly baseline", "OLS two features", "Ridge two features"]
PHASE_LEVELS = "(VALUES " + ", ".join(
    f"({i + 1}, '{label}')" for i, label in enumerate(PHASE_ORDER)) + ") AS pl(phase_rank, pandemic_phase)"
VOLUME_LEVELS = ("(VALUES (1, 'Small'), (2, 'Medium'), (3, 'Large'), (4, 'Very Large'))"
                 " AS vl(volume_rank, airport_volume_category)")


def _category(x: str) -> str:
    q = [f"(SELECT q[{i}] FROM edges)" for i in range(1, 6)]
    return f"""CASE WHEN {x} IS NULL OR {x} < {q[0]} OR {x} > {q[4]} THEN NULL
      WHEN {x} <= {q[1]} THEN 'Small' WHEN {x} <= {q[2]} THEN 'Medium'
      WHEN {x} <= {q[3]} THEN 'Large' ELSE 'Very Large' END"""


def _calendar(d: str = "FLT_DATE") -> str:
    return f"""CAST(isodow({d}) - 1 AS INTEGER) AS day_of_week,
      CAST(day({d}) AS INTEGER) AS day_of_month,
      CAST(dayofyear({d}) AS INTEGER) AS day_of_year,
      CAST(weekofyear({d}) AS INTEGER) AS week_of_year,
      CAST(quarter({d}) AS INTEGER) AS quarter,
      CAST(CASE WHEN isodow({d}) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
      sin(2 * pi() * dayofyear({d}) / 365.25) AS day_of_year_sin,
      cos(2 * pi() * dayofyear({d}) / 365.25) AS day_of_year_cos,
      sin(2 * pi() * month({d}) / 12) AS month_sin,
      cos(2 * pi() * month({d}) / 12) AS month_cos"""


BASE = f"""
WITH raw AS (
  SELECT s_name AS APT_ICAO, n_name AS STATE_NAME,
         CASE WHEN l_suppkey % 10 = 9 AND CAST(l_shipdate AS DATE) + 7670 < DATE '2020-01-01'
              THEN DATE '2020-01-01' + CAST((CAST(l_shipdate AS DATE) + 7670 - DATE '2016-01-01') % 1000 AS INTEGER)
              ELSE CAST(l_shipdate AS DATE) + 7670 END AS FLT_DATE,
         CAST(SUM(l_quantity) AS BIGINT) AS FLT_TOT_1,
         CAST(SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS BIGINT) AS FLT_ARR_1,
         CAST(SUM(CASE WHEN l_linestatus <> 'F' THEN l_quantity ELSE 0 END) AS BIGINT) AS FLT_DEP_1
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3
),
traffic AS (
  SELECT CAST(year(FLT_DATE) AS INTEGER) AS YEAR, CAST(month(FLT_DATE) AS INTEGER) AS MONTH_NUM,
         FLT_DATE, APT_ICAO, STATE_NAME, FLT_DEP_1, FLT_ARR_1, FLT_TOT_1
  FROM raw
),
pre AS (SELECT * FROM traffic WHERE YEAR < 2020),
monthly AS (
  SELECT APT_ICAO, MONTH_NUM, AVG(FLT_TOT_1) AS avg_pre_pandemic_monthly_traffic
  FROM pre WHERE APT_ICAO IS NOT NULL AND MONTH_NUM IS NOT NULL GROUP BY 1, 2
),
overall AS (
  SELECT APT_ICAO, AVG(FLT_TOT_1) AS avg_traffic_pre_pandemic_overall
  FROM pre WHERE APT_ICAO IS NOT NULL GROUP BY 1
),
gm AS (SELECT AVG(FLT_TOT_1) AS g FROM pre),
enriched AS (
  SELECT t.*,
         COALESCE(m.avg_pre_pandemic_monthly_traffic, (SELECT g FROM gm)) AS avg_pre_pandemic_monthly_traffic,
         COALESCE(o.avg_traffic_pre_pandemic_overall, (SELECT g FROM gm)) AS avg_traffic_pre_pandemic_overall
  FROM traffic t
  LEFT JOIN monthly m ON t.APT_ICAO = m.APT_ICAO AND t.MONTH_NUM = m.MONTH_NUM
  LEFT JOIN overall o ON t.APT_ICAO = o.APT_ICAO
),
edges AS (
  SELECT quantile_cont(avg_traffic_pre_pandemic_overall, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q
  FROM enriched
),
top_apt AS (
  SELECT APT_ICAO FROM traffic WHERE APT_ICAO IS NOT NULL
  GROUP BY 1 ORDER BY COUNT(*) DESC, APT_ICAO LIMIT 40
),
top_state AS (
  SELECT STATE_NAME FROM traffic WHERE STATE_NAME IS NOT NULL
  GROUP BY 1 ORDER BY COUNT(*) DESC, STATE_NAME LIMIT 15
),
feat AS (
  SELECT e.*, {_calendar()},
         {_phase_case()} AS pandemic_phase,
         {_category('avg_traffic_pre_pandemic_overall')} AS airport_volume_category,
         ln(1 + FLT_TOT_1) AS FLT_TOT_1_log,
         CASE WHEN APT_ICAO IN (SELECT APT_ICAO FROM top_apt) THEN APT_ICAO ELSE 'Other' END AS apt_group,
         CASE WHEN STATE_NAME IN (SELECT STATE_NAME FROM top_state) THEN STATE_NAME ELSE 'Other' END
           AS state_group
  FROM enriched e
),
train AS (SELECT * FROM feat WHERE FLT_DATE < DATE '{SPLIT}'),
sel AS (SELECT * FROM feat WHERE FLT_DATE BETWEEN DATE '{START}' AND DATE '{END}'),
requests AS (
  SELECT s_name AS airport,
         unnest([{", ".join(f"DATE '{d}'" for d in REQUEST_DATES)}]) AS flt_date
  FROM supplier
  UNION ALL
  SELECT '{UNKNOWN_AIRPORT_PREFIX}' || n_name,
         unnest([{", ".join(f"DATE '{d}'" for d in REQUEST_DATES[-2:])}])
  FROM nation
),
coordinates AS (
  SELECT s_name AS airport, CAST(35.0 AS DOUBLE) + (s_suppkey % 25) * CAST(1.01 AS DOUBLE) AS lat,
         CAST(-10.0 AS DOUBLE) + s_nationkey * CAST(1.5 AS DOUBLE) AS lon
  FROM supplier WHERE s_suppkey % 3 <> 0
),
country_labels AS (
  SELECT 'en' AS lang, n_name AS name, 'Nation ' || CAST(n_nationkey AS VARCHAR) AS label
  FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL
  SELECT 'fr', n_name, 'Pays ' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey % 2 = 0
)"""

TRAFFIC_COLS = "YEAR, MONTH_NUM, FLT_DATE, APT_ICAO, STATE_NAME, FLT_DEP_1, FLT_ARR_1, FLT_TOT_1"


def _pareto(key: str, where: str) -> str:
    return BASE + f""",
per AS (SELECT {key} AS APT_ICAO, COALESCE(SUM(FLT_TOT_1), 0) AS total FROM sel GROUP BY 1),
grand AS (SELECT CAST(SUM(total) AS DOUBLE) AS g FROM per),
top AS (SELECT * FROM per WHERE {where} ORDER BY total DESC, APT_ICAO LIMIT 10)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY total DESC, APT_ICAO) AS INTEGER) AS rank, APT_ICAO,
       CAST(total AS BIGINT) AS total,
       round(CAST(SUM(total) OVER (ORDER BY total DESC, APT_ICAO
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
             / (SELECT g FROM grand) * 100, 6) AS cumulative_pct
FROM top"""


def _log_by(key: str) -> str:
    return f"SELECT {key}, round(AVG(FLT_TOT_1_log), 6) AS mean_log_total FROM train"


def _spread_cols() -> str:
    return """round(MIN(FLT_TOT_1_log), 6) AS min_log,
       round(quantile_cont(FLT_TOT_1_log, 0.25), 6) AS q1_log,
       round(quantile_cont(FLT_TOT_1_log, 0.5), 6) AS median_log,
       round(quantile_cont(FLT_TOT_1_log, 0.75), 6) AS q3_log,
       round(MAX(FLT_TOT_1_log), 6) AS max_log"""


def _compact(x: str) -> str:
    return f"""CASE WHEN abs({x}) >= 1000000 THEN printf('%.1fM', CAST({x} AS DOUBLE) / 1000000)
            WHEN abs({x}) >= 1000 THEN printf('%.1fK', CAST({x} AS DOUBLE) / 1000)
            ELSE CAST({x} AS VARCHAR) END"""


def _metric_rows(splits=("train", "test")) -> str:
    parts = []
    for split in splits:
        for scale, n, var, sse, sae in (
                ("log_scale", "ln_n", "ln_var", "ln_sse", "ln_sae"),
                ("original_scale", "o_n", "o_var", "o_sse", "o_sae")):
            parts.append(f"SELECT '{split}' AS split, '{scale}' AS scale, 'R2' AS metric, "
                         f"round(1 - {sse} / ({var} * {n}), 6) AS value FROM s WHERE split = '{split}'")
            parts.append(f"SELECT '{split}', '{scale}', 'MAE', round({sae} / {n}, 6) FROM s WHERE split = '{split}'")
            parts.append(f"SELECT '{split}', '{scale}', 'RMSE', round(sqrt({sse} / {n}), 6) FROM s WHERE split = '{split}'")
    return "\nUNION ALL\n".join(parts)


def _no_negative_zero(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)`` so -0.0 prints as
    0.0, as it does on the Spark side."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len("round")
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j])
        out.append("(" + sql[j:k + 1] + " + CAST(0 AS DOUBLE))")
        i = k + 1


def oracle_sql() -> dict[str, str]:
    return {k: _no_negative_zero(v) for k, v in _oracle_sql().items()}


def _oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_traffic"] = BASE + f"\nSELECT {TRAFFIC_COLS} FROM traffic"
    q["date_bounds"] = BASE + "\nSELECT MIN(FLT_DATE) AS first_day, MAX(FLT_DATE) AS last_day FROM traffic"
    q["ops_in_range"] = BASE + f"\nSELECT {TRAFFIC_COLS} FROM traffic WHERE FLT_DATE BETWEEN DATE '{START}' AND DATE '{END}'"
    q["split_profile"] = BASE + f"""
SELECT CAST(COUNT(*) FILTER (WHERE FLT_DATE < DATE '{SPLIT}') AS BIGINT) AS train_rows,
       CAST(COUNT(*) FILTER (WHERE FLT_DATE >= DATE '{SPLIT}') AS BIGINT) AS test_rows,
       round(CAST(COUNT(*) FILTER (WHERE FLT_DATE < DATE '{SPLIT}') AS DOUBLE)
             / COUNT(*) FILTER (WHERE FLT_DATE IS NOT NULL), 6) AS train_fraction
FROM traffic"""
    q["pareto_airports"] = _pareto("apt_group", "TRUE")
    q["pareto_airports_unfolded"] = _pareto("APT_ICAO", "APT_ICAO IS NOT NULL")
    q["kpi_totals"] = BASE + """
SELECT CAST(COALESCE(SUM(FLT_TOT_1), 0) AS BIGINT) AS total_ops,
       CAST(COALESCE(SUM(FLT_ARR_1), 0) AS BIGINT) AS total_arrivals,
       CAST(COALESCE(SUM(FLT_DEP_1), 0) AS BIGINT) AS total_departures
FROM sel"""
    q["kpi_empty_range"] = BASE + f"""
SELECT CAST(COALESCE(SUM(FLT_TOT_1) FILTER (WHERE FLT_DATE BETWEEN DATE '{EMPTY_RANGE[0]}' AND DATE '{EMPTY_RANGE[1]}'), 0)
            AS BIGINT) AS total_ops,
       CAST(COALESCE(SUM(FLT_TOT_1) FILTER (WHERE FLT_DATE BETWEEN DATE '{REF_START}' AND DATE '{REF_END}'), 0)
            AS BIGINT) AS total_ops_2019,
       CAST(NULL AS DOUBLE) AS change_pct
FROM traffic"""
    q["utc_dates"] = "SELECT event_id, CAST(ts AS DATE) AS utc_day FROM events"
    sums = f"""s AS (
  SELECT CAST(COALESCE(SUM(CASE WHEN FLT_DATE BETWEEN DATE '{START}' AND DATE '{END}' THEN FLT_TOT_1 END), 0) AS BIGINT) AS total_ops,
         CAST(COALESCE(SUM(CASE WHEN FLT_DATE BETWEEN DATE '{START}' AND DATE '{END}' THEN FLT_ARR_1 END), 0) AS BIGINT) AS total_arrivals,
         CAST(COALESCE(SUM(CASE WHEN FLT_DATE BETWEEN DATE '{START}' AND DATE '{END}' THEN FLT_DEP_1 END), 0) AS BIGINT) AS total_departures,
         CAST(COALESCE(SUM(CASE WHEN FLT_DATE BETWEEN DATE '{REF_START}' AND DATE '{REF_END}' THEN FLT_TOT_1 END), 0) AS BIGINT) AS total_ops_2019,
         COUNT(*) FILTER (WHERE FLT_DATE BETWEEN DATE '{START}' AND DATE '{END}') AS rows_in_range
  FROM traffic),
c AS (SELECT *, CASE WHEN total_ops_2019 > 0 AND rows_in_range > 0
                     THEN (total_ops - total_ops_2019) / total_ops_2019 * 100 END AS change_pct FROM s)"""
    q["kpi_change"] = BASE + f""",
{sums}
SELECT total_ops, total_ops_2019, round(change_pct, 6) AS change_pct FROM c"""
    q["kpi_labels"] = BASE + f""",
{sums}
SELECT {_compact('total_ops')} AS total_label,
       {_compact('total_arrivals')} AS arrivals_label,
       {_compact('total_departures')} AS departures_label,
       CASE WHEN change_pct IS NULL THEN '-' ELSE printf('%+.1f%%', change_pct) END AS change_text,
       CASE WHEN change_pct > 0 THEN 'kpi-change-positive' WHEN change_pct < 0 THEN 'kpi-change-negative'
            ELSE 'kpi-change-neutral' END AS change_class
FROM c"""
    q["daily_ops"] = BASE + """
SELECT FLT_DATE, CAST(COALESCE(SUM(FLT_ARR_1), 0) AS BIGINT) AS arrivals,
       CAST(COALESCE(SUM(FLT_DEP_1), 0) AS BIGINT) AS departures
FROM sel GROUP BY FLT_DATE"""
    q["top_countries"] = BASE + """
SELECT state_group AS STATE_NAME, CAST(COALESCE(SUM(FLT_TOT_1), 0) AS BIGINT) AS total
FROM sel GROUP BY 1 ORDER BY total DESC, STATE_NAME LIMIT 15"""
    q["top_countries_unfolded"] = BASE + """
SELECT STATE_NAME, CAST(COALESCE(SUM(FLT_TOT_1), 0) AS BIGINT) AS total
FROM sel WHERE STATE_NAME IS NOT NULL GROUP BY 1 ORDER BY total DESC, STATE_NAME LIMIT 15"""
    q["volume_share_observed"] = BASE + f""",
v AS (SELECT airport_volume_category, SUM(FLT_TOT_1) AS total FROM sel
      WHERE airport_volume_category IS NOT NULL GROUP BY 1),
l AS (SELECT vl.volume_rank, vl.airport_volume_category, CAST(v.total AS BIGINT) AS total
      FROM {VOLUME_LEVELS} JOIN v ON vl.airport_volume_category = v.airport_volume_category)
SELECT CAST(volume_rank AS INTEGER) AS volume_rank, airport_volume_category, total,
       round(CASE WHEN SUM(total) OVER () > 0 THEN total / CAST(SUM(total) OVER () AS DOUBLE) * 100 END, 6)
         AS share_pct
FROM l"""
    q["volume_share"] = BASE + f""",
v AS (SELECT airport_volume_category, SUM(FLT_TOT_1) AS total FROM sel
      WHERE airport_volume_category IS NOT NULL GROUP BY 1),
l AS (SELECT vl.volume_rank, vl.airport_volume_category, CAST(COALESCE(v.total, 0) AS BIGINT) AS total
      FROM {VOLUME_LEVELS} LEFT JOIN v ON vl.airport_volume_category = v.airport_volume_category)
SELECT CAST(volume_rank AS INTEGER) AS volume_rank, airport_volume_category, total,
       round(CASE WHEN SUM(total) OVER () > 0 THEN total / CAST(SUM(total) OVER () AS DOUBLE) * 100 END, 6)
         AS share_pct
FROM l"""
    for key, weekday in (("daytype_share", "Weekday"), ("daytype_share_fr", "Jour de semaine")):
        q[key] = BASE + f""",
d AS (SELECT CASE WHEN is_weekend = 1 THEN 'Weekend' ELSE '{weekday}' END AS day_type,
             CAST(COALESCE(SUM(FLT_TOT_1), 0) AS BIGINT) AS total FROM sel GROUP BY 1)
SELECT day_type, total,
       round(CASE WHEN SUM(total) OVER () > 0 THEN total / CAST(SUM(total) OVER () AS DOUBLE) * 100 END, 6)
         AS share_pct
FROM d"""
    q["calendar_features"] = BASE + """
SELECT APT_ICAO, FLT_DATE, day_of_week, day_of_month, day_of_year, week_of_year, quarter, is_weekend
FROM feat"""
    q["cyclic_features"] = BASE + """
SELECT APT_ICAO, FLT_DATE, round(day_of_year_sin, 6) AS day_of_year_sin,
       round(day_of_year_cos, 6) AS day_of_year_cos, round(month_sin, 6) AS month_sin,
       round(month_cos, 6) AS month_cos
FROM feat"""
    q["phase_labels"] = BASE + f""",
p AS (SELECT DISTINCT YEAR, MONTH_NUM, {_phase_case()} AS pandemic_phase FROM traffic)
SELECT p.YEAR, p.MONTH_NUM, p.pandemic_phase, CAST(pl.phase_rank AS INTEGER) AS phase_rank
FROM p LEFT JOIN {PHASE_LEVELS} ON p.pandemic_phase = pl.pandemic_phase"""
    q["log_roundtrip"] = BASE + """
SELECT APT_ICAO, FLT_DATE, FLT_TOT_1, round(ln(1 + FLT_TOT_1), 6) AS FLT_TOT_1_log,
       round(exp(ln(1 + FLT_TOT_1)) - 1, 6) AS roundtrip
FROM traffic"""
    q["baseline_monthly"] = BASE + """
SELECT APT_ICAO, MONTH_NUM, round(avg_pre_pandemic_monthly_traffic, 6) AS avg_pre_pandemic_monthly_traffic
FROM monthly"""
    q["baseline_overall"] = BASE + """
SELECT APT_ICAO, round(avg_traffic_pre_pandemic_overall, 6) AS avg_traffic_pre_pandemic_overall
FROM overall"""
    q["baseline_enriched"] = BASE + """
SELECT APT_ICAO, FLT_DATE, MONTH_NUM,
       round(avg_pre_pandemic_monthly_traffic, 6) AS avg_pre_pandemic_monthly_traffic,
       round(avg_traffic_pre_pandemic_overall, 6) AS avg_traffic_pre_pandemic_overall
FROM enriched"""
    q["lookup_all_years"] = BASE + """,
m AS (SELECT APT_ICAO, MONTH_NUM, AVG(FLT_TOT_1) AS a FROM traffic
      WHERE APT_ICAO IS NOT NULL AND MONTH_NUM IS NOT NULL GROUP BY 1, 2),
o AS (SELECT APT_ICAO, AVG(FLT_TOT_1) AS a FROM traffic WHERE APT_ICAO IS NOT NULL GROUP BY 1)
SELECT m.APT_ICAO, m.MONTH_NUM, round(m.a, 6) AS avg_monthly_all_years,
       round(o.a, 6) AS avg_overall_all_years
FROM m JOIN o ON m.APT_ICAO = o.APT_ICAO"""
    q["volume_bins"] = BASE + """
SELECT CAST(i - 1 AS INTEGER) AS edge_index,
       CAST([0.0, 0.25, 0.5, 0.75, 1.0][i] AS DOUBLE) AS probability,
       round((SELECT q FROM edges)[i], 6) AS edge
FROM (SELECT unnest(range(1, 6)) AS i)"""
    q["volume_category"] = BASE + """
SELECT DISTINCT APT_ICAO, round(avg_traffic_pre_pandemic_overall, 6) AS avg_traffic_pre_pandemic_overall,
       airport_volume_category
FROM feat WHERE APT_ICAO IS NOT NULL"""
    q["monthly_series"] = BASE + """,
s AS (SELECT last_day(FLT_DATE) AS month_end, SUM(FLT_TOT_1) AS total FROM train GROUP BY 1),
cal AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', MIN(FLT_DATE)),
                                                    date_trunc('month', MAX(FLT_DATE)),
                                                    INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM train)
SELECT cal.month_end, CAST(COALESCE(s.total, 0) AS BIGINT) AS total
FROM cal LEFT JOIN s ON cal.month_end = s.month_end"""
    q["log_by_dow"] = BASE + "\n" + _log_by("day_of_week") + " WHERE day_of_week IS NOT NULL GROUP BY 1"
    q["log_by_phase"] = BASE + f""",
m AS ({_log_by("pandemic_phase")} WHERE pandemic_phase IS NOT NULL GROUP BY 1)
SELECT CAST(pl.phase_rank AS INTEGER) AS phase_rank, m.pandemic_phase, m.mean_log_total
FROM m LEFT JOIN {PHASE_LEVELS} ON m.pandemic_phase = pl.pandemic_phase"""
    q["log_by_volume"] = BASE + f""",
m AS ({_log_by("airport_volume_category")} WHERE airport_volume_category IS NOT NULL GROUP BY 1)
SELECT CAST(vl.volume_rank AS INTEGER) AS volume_rank, vl.airport_volume_category, m.mean_log_total
FROM {VOLUME_LEVELS} LEFT JOIN m ON vl.airport_volume_category = m.airport_volume_category"""
    q["spread_by_dow"] = BASE + f"""
SELECT day_of_week, {_spread_cols()} FROM train
WHERE day_of_week IS NOT NULL AND FLT_TOT_1_log IS NOT NULL GROUP BY 1"""
    q["spread_by_phase"] = BASE + f""",
m AS (SELECT pandemic_phase, {_spread_cols()} FROM train
      WHERE pandemic_phase IS NOT NULL AND FLT_TOT_1_log IS NOT NULL GROUP BY 1)
SELECT m.*, CAST(pl.phase_rank AS INTEGER) AS phase_rank
FROM m LEFT JOIN {PHASE_LEVELS} ON m.pandemic_phase = pl.pandemic_phase"""
    q["spread_by_volume"] = BASE + f""",
m AS (SELECT airport_volume_category, {_spread_cols()} FROM train
      WHERE airport_volume_category IS NOT NULL AND FLT_TOT_1_log IS NOT NULL GROUP BY 1)
SELECT CAST(vl.volume_rank AS INTEGER) AS volume_rank, vl.airport_volume_category,
       m.min_log, m.q1_log, m.median_log, m.q3_log, m.max_log
FROM {VOLUME_LEVELS} LEFT JOIN m ON vl.airport_volume_category = m.airport_volume_category"""
    corr_parts = [f"SELECT '{c}' AS feature, round(corr(CAST({c} AS DOUBLE), FLT_TOT_1_log), 6) AS correlation FROM train"
                  for c in CORRELATION_FEATURES + ["FLT_TOT_1_log"]]
    q["target_correlation"] = BASE + "\n" + "\nUNION ALL\n".join(corr_parts)
    q["airport_map"] = BASE + """
SELECT o.APT_ICAO, round(o.avg_traffic_pre_pandemic_overall, 6) AS avg_traffic_pre_pandemic_overall,
       round(c.lat, 6) AS lat, round(c.lon, 6) AS lon
FROM overall o JOIN coordinates c ON o.APT_ICAO = c.airport
WHERE c.lat IS NOT NULL AND c.lon IS NOT NULL"""
    q["mapped_airports"] = BASE + """
SELECT DISTINCT APT_ICAO, STATE_NAME FROM traffic
WHERE APT_ICAO IN (SELECT airport FROM coordinates)"""
    for key, lang in (("airport_directory", "en"), ("airport_directory_fr", "fr")):
        q[key] = BASE + f""",
ac AS (SELECT DISTINCT APT_ICAO, STATE_NAME FROM traffic WHERE APT_ICAO IS NOT NULL),
lab AS (SELECT name, label FROM country_labels WHERE lang = '{lang}')
SELECT ac.APT_ICAO, ac.STATE_NAME, COALESCE(lab.label, ac.STATE_NAME) AS country_label,
       ac.APT_ICAO || ' (' || COALESCE(lab.label, ac.STATE_NAME) || ')' AS label
FROM ac LEFT JOIN lab ON ac.STATE_NAME = lab.name"""
    q["fold_rare_keys"] = BASE + """
SELECT apt_group AS APT_ICAO, state_group AS STATE_NAME, CAST(COUNT(*) AS BIGINT) AS rows,
       CAST(SUM(FLT_TOT_1) AS BIGINT) AS total
FROM feat GROUP BY 1, 2"""
    q["metric_table"] = BASE + f""",
sc AS (SELECT CASE WHEN FLT_DATE < DATE '{SPLIT}' THEN 'train' ELSE 'test' END AS split,
              ln(1 + FLT_TOT_1) AS yl, ln(1 + avg_pre_pandemic_monthly_traffic) AS pl,
              CAST(FLT_TOT_1 AS DOUBLE) AS y,
              greatest(0.0, exp(ln(1 + avg_pre_pandemic_monthly_traffic)) - 1) AS p
       FROM feat WHERE FLT_DATE IS NOT NULL AND FLT_TOT_1 IS NOT NULL),
s AS (SELECT split, CAST(COUNT(*) AS DOUBLE) AS ln_n, var_pop(yl) AS ln_var,
             SUM((yl - pl) * (yl - pl)) AS ln_sse, SUM(abs(yl - pl)) AS ln_sae,
             CAST(COUNT(*) AS DOUBLE) AS o_n, var_pop(y) AS o_var,
             SUM((y - p) * (y - p)) AS o_sse, SUM(abs(y - p)) AS o_sae
      FROM sc GROUP BY 1)
{_metric_rows()}"""
    q["checked_scan"] = BASE + """
SELECT YEAR, COUNT(*) AS rows, COUNT(*) FILTER (WHERE day(FLT_DATE) <> 29) AS with_total,
       CAST(SUM(FLT_TOT_1) FILTER (WHERE day(FLT_DATE) <> 29) AS BIGINT) AS total, MIN(FLT_DATE) AS first_day
FROM traffic WHERE day(FLT_DATE) NOT IN (13, 28) GROUP BY YEAR"""
    q["rejected_rows"] = BASE + """
SELECT CASE WHEN day(FLT_DATE) = 13 THEN 'FLT_DATE: no date' ELSE 'FLT_TOT_1: no whole number' END AS reason, COUNT(*) AS rows
FROM traffic WHERE day(FLT_DATE) IN (13, 28) GROUP BY 1"""
    a, b = TWO_FEATURES
    two = f""",
u AS (SELECT CAST({a} AS DOUBLE) AS x1, CAST({b} AS DOUBLE) AS x2, ln(1 + FLT_TOT_1) AS y FROM train WHERE FLT_TOT_1 IS NOT NULL),
o AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2,
             covar_pop(x1, x2) AS v12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM u),
ols AS (SELECT *, (v2 * c1 - v12 * c2) / (v1 * v2 - v12 * v12) AS w1, (v1 * c2 - v12 * c1) / (v1 * v2 - v12 * v12) AS w2 FROM o),
rr AS (SELECT *, 1 + 1 / n AS d, v12 / sqrt(v1 * v2) AS r, c1 / sqrt(v1) AS g1, c2 / sqrt(v2) AS g2 FROM o),
ridge AS (SELECT *, (d * g1 - r * g2) / (d * d - r * r) AS w1, (d * g2 - r * g1) / (d * d - r * r) AS w2 FROM rr)"""
    q["ols_two_features"] = BASE + two + f"""
SELECT 'intercept' AS term, round(my - w1 * m1 - w2 * m2, 6) AS coefficient FROM ols
UNION ALL SELECT '{a}', round(w1, 6) FROM ols UNION ALL SELECT '{b}', round(w2, 6) FROM ols"""
    q["ridge_two_features"] = BASE + two + f"""
SELECT 'intercept' AS term, round(my, 6) AS coefficient FROM ridge
UNION ALL SELECT '{a}', round(w1, 6) FROM ridge UNION ALL SELECT '{b}', round(w2, 6) FROM ridge"""
    card = two + f""",
each AS (SELECT CASE WHEN FLT_DATE < DATE '{SPLIT}' THEN 'train' ELSE 'test' END AS split, ln(1 + FLT_TOT_1) AS yl,
                CAST(FLT_TOT_1 AS DOUBLE) AS y,
                unnest([{{'model': 'Monthly baseline', 'pl': ln(1 + avg_pre_pandemic_monthly_traffic)}},
                        {{'model': 'OLS two features',
                          'pl': ols.my + ols.w1 * ({a} - ols.m1) + ols.w2 * ({b} - ols.m2)}},
                        {{'model': 'Ridge two features',
                          'pl': ols.my + ridge.w1 * ({a} - ols.m1) / sqrt(ols.v1)
                                + ridge.w2 * ({b} - ols.m2) / sqrt(ols.v2)}}]) AS e
         FROM feat, ols, ridge WHERE FLT_DATE IS NOT NULL AND FLT_TOT_1 IS NOT NULL),
sc AS (SELECT e.model || '|' || split AS split, yl, e.pl AS pl, y, greatest(0.0, exp(e.pl) - 1) AS p FROM each),
s AS (SELECT split, CAST(COUNT(*) AS DOUBLE) AS ln_n, var_pop(yl) AS ln_var,
             SUM((yl - pl) * (yl - pl)) AS ln_sse, SUM(abs(yl - pl)) AS ln_sae,
             CAST(COUNT(*) AS DOUBLE) AS o_n, var_pop(y) AS o_var,
             SUM((y - p) * (y - p)) AS o_sse, SUM(abs(y - p)) AS o_sae
      FROM sc GROUP BY 1),
card AS ({_metric_rows([f'{m}|{x}' for m in CLOSED_FORM for x in ('train', 'test')])})
SELECT split_part(split, '|', 1) AS model, split_part(split, '|', 2) AS split, scale, metric, value FROM card"""
    q["closed_form_scorecard"] = BASE + card
    q["scorecard_by_name"] = BASE + card + " WHERE split LIKE 'Ridge two features|%'"
    names = [*CORRELATION_FEATURES, "FLT_TOT_1_log"]
    pair = ", ".join(f"{{'feature_a': '{x}', 'feature_b': '{y}', 'r': corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))}}"
                     for x in names for y in names)
    q["correlation_matrix"] = BASE + f""",
c AS (SELECT unnest([{pair}]) AS e FROM train)
SELECT e.feature_a AS feature_a, e.feature_b AS feature_b, round(e.r, 6) AS correlation FROM c"""
    parts = [f"""SELECT '{c}' AS feature, split, round((avg(CAST({c} AS DOUBLE)) - any_value(t.m)) / any_value(t.s), 6) + 0.0 AS mean_z,
       round(stddev_pop(CAST({c} AS DOUBLE)) / any_value(t.s), 6) + 0.0 AS std_z
FROM sp, (SELECT avg(CAST({c} AS DOUBLE)) AS m, stddev_pop(CAST({c} AS DOUBLE)) AS s FROM train) t GROUP BY split"""
             for c in NUMERICAL_FEATURES]
    q["standardized_features"] = BASE + f""",
sp AS (SELECT *, CASE WHEN FLT_DATE < DATE '{SPLIT}' THEN 'train' ELSE 'test' END AS split FROM feat WHERE FLT_DATE IS NOT NULL)
""" + "\nUNION ALL\n".join(parts)
    scoring = f""",
ac AS (SELECT APT_ICAO, MIN(STATE_NAME) AS STATE_NAME FROM traffic WHERE APT_ICAO IS NOT NULL GROUP BY 1),
r AS (SELECT airport AS APT_ICAO, flt_date AS FLT_DATE,
             CAST(year(flt_date) AS INTEGER) AS YEAR, CAST(month(flt_date) AS INTEGER) AS MONTH_NUM
      FROM requests),
rf AS (
  SELECT r.*, {_calendar('r.FLT_DATE')}, {_phase_case('r.YEAR', 'r.MONTH_NUM')} AS pandemic_phase,
         COALESCE(ac.STATE_NAME, 'Other') AS STATE_NAME,
         COALESCE(m.avg_pre_pandemic_monthly_traffic, (SELECT g FROM gm)) AS avg_pre_pandemic_monthly_traffic,
         COALESCE(o.avg_traffic_pre_pandemic_overall, (SELECT g FROM gm)) AS avg_traffic_pre_pandemic_overall
  FROM r LEFT JOIN ac ON r.APT_ICAO = ac.APT_ICAO
  LEFT JOIN monthly m ON r.APT_ICAO = m.APT_ICAO AND r.MONTH_NUM = m.MONTH_NUM
  LEFT JOIN overall o ON r.APT_ICAO = o.APT_ICAO
)"""
    q["scoring_features"] = BASE + scoring + f"""
SELECT APT_ICAO, FLT_DATE, YEAR, MONTH_NUM, day_of_month, is_weekend,
       round(avg_pre_pandemic_monthly_traffic, 6) AS avg_pre_pandemic_monthly_traffic,
       round(avg_traffic_pre_pandemic_overall, 6) AS avg_traffic_pre_pandemic_overall,
       round(day_of_year_sin, 6) AS day_of_year_sin, round(day_of_year_cos, 6) AS day_of_year_cos,
       round(month_sin, 6) AS month_sin, round(month_cos, 6) AS month_cos,
       STATE_NAME, day_of_week, quarter, pandemic_phase,
       {_category('avg_traffic_pre_pandemic_overall')} AS airport_volume_category
FROM rf"""
    q["forecast_context"] = BASE + """
SELECT r.airport AS APT_ICAO, r.flt_date AS FLT_DATE, strftime(r.flt_date, '%B') AS month_name,
       round(m.avg_pre_pandemic_monthly_traffic, 6) AS historical_avg
FROM requests r LEFT JOIN monthly m
  ON r.airport = m.APT_ICAO AND CAST(month(r.flt_date) AS INTEGER) = m.MONTH_NUM"""
    return q
