"""The queries in DuckDB SQL over the raw tables, written apart from the Spark plans.

Builds are spelled out the long way (one pass for each of a day's three
partitions, literal joins), so that agreement means something.
"""

from __future__ import annotations

from pathloom.functions.columns import AXES, COND_AXES
from pathloom.plans.cubes import PATH_TOP

FIRST, LAST = "2024-01-01", "2024-01-30"
#: The cut of the query that shows the rest row.
TOP = 5

BASE = r"""
e0 AS (SELECT event_id, cast(user_id AS varchar) AS uuid, user_id, ts, event_type, value, cast(regexp_extract(props, '"k":\s*(\d+)', 1) AS integer) AS k FROM events),
e1 AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM e0),
e2 AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e1),
raw AS (
  SELECT event_id, uuid, cast(cast(n AS bigint) AS varchar) AS suid, ts, strftime(ts + INTERVAL 10 MINUTE, '%Y-%m-%d') AS date_id, k,
    CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN 'Pageview' WHEN event_type = 'click' THEN 'Event' WHEN k < 70 THEN 'Usage' ELSE 'App' END AS action_type,
    CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN CASE WHEN k % 10 <> 0 THEN 'ViewPage' END WHEN event_type = 'click' THEN CASE WHEN k % 2 = 0 THEN 'ClickContent' END
         WHEN k < 70 THEN 'UsagePage' WHEN k < 85 THEN 'AppExit' ELSE 'AppLaunch' END AS action_kind,
    CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN CASE WHEN k % 25 <> 0 THEN 's' || (k % 6) END ELSE event_type END AS action_name,
    'p' || (k % 4) AS page, CASE WHEN k < 60 THEN 'top' WHEN k < 90 THEN 'media' ELSE 'sports' END AS service_code,
    CASE WHEN event_type = 'click' AND k % 4 <> 0 THEN 'L' || (k % 5) END AS layer1, CASE WHEN event_type = 'click' AND k % 4 <> 0 AND k % 7 <> 0 THEN 'M' || (k % 3) END AS layer2,
    CASE WHEN event_type = 'error' AND k < 70 THEN value * 1000 END AS usage_duration_ms,
    CASE WHEN day(ts) - 1 + user_id % 10 >= 18 THEN '2.0' ELSE '1.0' END AS raw_version,
    CASE user_id % 3 WHEN 0 THEN 'MA' WHEN 1 THEN 'MW' ELSE 'PW' END AS service_type,
    CASE user_id % 5 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' WHEN 2 THEN 'windows' WHEN 3 THEN 'macos' ELSE 'other' END AS os,
    lpad(cast(hour(ts) // 6 * 6 AS varchar), 2, '0') || '~' || lpad(cast(hour(ts) // 6 * 6 + 5 AS varchar), 2, '0') AS daypart, k <> 99 AS is_valid
  FROM e2),
dim AS (
  SELECT cast(c_custkey AS varchar) AS uuid, CASE c_nationkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'N' END AS gender, (c_nationkey % 8) * 10 AS band
  FROM customer WHERE c_custkey % 5 <> 0),
ev_all AS (
  SELECT raw.*, coalesce(gender, 'unknown') AS gender, CASE WHEN band IS NULL OR band = 0 THEN 'unknown' ELSE cast(band AS varchar) END AS age_band
  FROM raw LEFT JOIN dim USING (uuid) WHERE date_id BETWEEN '2023-12-31' AND '2024-01-31'),
ev AS (SELECT * FROM ev_all WHERE is_valid)"""

_NAME = "service_code || '/' || coalesce(nullif(trim(action_name), ''), '(none)')"
_VALUES = {
    "screens": (_NAME, "action_type = 'Pageview'"),
    "layer1": ("nullif(trim(layer1), '')", "nullif(trim(layer1), '') IS NOT NULL"),
    "layer2": ("trim(layer1) || '>' || coalesce(nullif(trim(layer2), ''), '(none)')", "nullif(trim(layer1), '') IS NOT NULL"),
    "versions": ("nullif(trim(raw_version), '')", "nullif(trim(raw_version), '') IS NOT NULL"),
}


def _dict(kind: str) -> str:
    value, cond = _VALUES[kind]
    most = " AND rank <= 16" if kind == "versions" else ""
    return f"""
n_{kind} AS (SELECT {value} AS value, count(DISTINCT (uuid, suid)) AS cnt FROM ev WHERE date_id BETWEEN '{FIRST}' AND '{LAST}' AND {cond} GROUP BY 1),
d_{kind} AS (SELECT value, cnt, rank FROM (
  SELECT value, cnt, row_number() OVER (ORDER BY cnt DESC, value) AS rank, sum(cnt) OVER () AS total,
         coalesce(sum(cnt) OVER (ORDER BY cnt DESC, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n_{kind})
  WHERE before < 0.95 * total AND cnt >= 1{most})"""


DICTS = ",".join(_dict(k) for k in _VALUES)

_FIRST_AXES = ", ".join(f"first({a} ORDER BY ts, event_id) AS {a}" for a in AXES[1:-1])
KEPT = f"""
days AS (SELECT strftime(d, '%Y-%m-%d') AS period, strftime(d - INTERVAL 1 DAY, '%Y-%m-%d') AS before, strftime(d + INTERVAL 1 DAY, '%Y-%m-%d') AS after
         FROM range(DATE '{FIRST}', DATE '{LAST}' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d)),
evd AS (SELECT days.period, ev.*, CASE WHEN raw_version IN (SELECT value FROM d_versions) THEN raw_version ELSE 'other' END AS app_version
        FROM ev JOIN days ON ev.date_id IN (days.before, days.period, days.after)),
kept AS (
  SELECT period, uuid, suid, {_FIRST_AXES}, first(app_version ORDER BY ts, event_id) AS app_version,
         count(*) AS events, count(*) FILTER (WHERE action_type = 'Pageview') AS pv, date_sub('second', min(ts), max(ts)) AS duration_sec
  FROM evd GROUP BY period, uuid, suid HAVING strftime(min(ts), '%Y-%m-%d') = period)"""

VISITS = f"""
stream AS (
  SELECT *, CASE WHEN action_type = 'Pageview' THEN 1 ELSE 0 END AS is_screen,
    CASE WHEN action_type = 'Pageview' THEN CASE WHEN {_NAME} IN (SELECT value FROM d_screens) THEN {_NAME} ELSE service_code || '/other' END END AS state
  FROM evd),
marked AS (
  SELECT *, sum(is_screen) OVER (PARTITION BY period, uuid, suid ORDER BY ts, is_screen DESC, event_id ROWS UNBOUNDED PRECEDING) AS visit_idx FROM stream),
dwell AS (SELECT period, uuid, suid, visit_idx, sum(usage_duration_ms / 1000) AS dwell FROM marked
          WHERE action_type = 'Usage' AND action_kind = 'UsagePage' AND visit_idx > 0 AND usage_duration_ms IS NOT NULL GROUP BY ALL),
screens AS (SELECT m.period, m.uuid, m.suid, m.visit_idx, m.state, d.dwell FROM marked m LEFT JOIN dwell d USING (period, uuid, suid, visit_idx) WHERE is_screen = 1),
seq AS (SELECT s.*, lead(state) OVER w AS n1, lead(state, 2) OVER w AS n2, lead(state, 3) OVER w AS n3, lead(state, 4) OVER w AS n4
        FROM screens s SEMI JOIN kept USING (period, uuid, suid) WINDOW w AS (PARTITION BY period, uuid, suid ORDER BY visit_idx)),
edges AS (
  SELECT period, uuid, suid, visit_idx, state AS from_state, coalesce(n1, 'EXIT') AS to_state, dwell FROM seq
  UNION ALL SELECT period, uuid, suid, 0, 'START', state, NULL FROM seq WHERE visit_idx = 1),
clicks AS (
  SELECT m.period, m.uuid, m.suid, m.visit_idx, coalesce(s.state, 'START') AS screen, coalesce(nullif(trim(action_kind), ''), '(none)') AS action_kind,
    CASE WHEN trim(layer1) IN (SELECT value FROM d_layer1) THEN trim(layer1) ELSE 'other' END AS layer1,
    CASE WHEN {_VALUES['layer2'][0]} IN (SELECT value FROM d_layer2) THEN {_VALUES['layer2'][0]} ELSE 'other' END AS layer2
  FROM marked m LEFT JOIN screens s USING (period, uuid, suid, visit_idx)
  WHERE m.is_screen = 0 AND nullif(trim(layer1), '') IS NOT NULL)"""

_A = ", ".join(AXES)
_KA = ", ".join(f"k.{a}" for a in AXES)
_KC = ", ".join(f"k.{a}" for a in COND_AXES)
_SETS = ", ".join(
    ["(date, " + _A + ")"] + ["(date, " + ", ".join(a for a in AXES if a != drop) + ")" for drop in AXES[1:]] + ["(date, period)", "(date)"]
)
CUBE_SQL = {
    "session": f"""SELECT {_A}, count(*) AS sessions, count(DISTINCT uuid) AS uv, cast(sum(pv) AS bigint) AS pv, cast(sum(events) AS bigint) AS events, cast(sum(duration_sec) AS bigint) AS duration_sum, date
      FROM (SELECT *, period AS date FROM kept) GROUP BY GROUPING SETS ({_SETS})""",
    "transition": f"""SELECT {_KA}, from_state, to_state, count(*) AS cnt, coalesce(sum(dwell), 0.0) AS dur_sum, count(dwell) AS dur_n, k.period AS date
      FROM edges JOIN kept k USING (period, uuid, suid) GROUP BY ALL""",
    "action": f"""SELECT {_KA}, screen, action_kind, layer1, layer2, count(*) AS cnt, k.period AS date FROM clicks JOIN kept k USING (period, uuid, suid) GROUP BY ALL""",
    "cond_transition": f"""SELECT {_KC}, from_state, action_kind, to_state, count(*) AS cnt, k.period AS date FROM (
        SELECT e.period, e.uuid, e.suid, from_state, action_kind, to_state FROM edges e JOIN clicks c USING (period, uuid, suid, visit_idx)
        UNION ALL SELECT e.period, e.uuid, e.suid, from_state, '(no_click)', to_state FROM edges e ANTI JOIN clicks c USING (period, uuid, suid, visit_idx)) p
      JOIN kept k USING (period, uuid, suid) GROUP BY ALL""",
}


def _paths(top: int) -> str:
    return f"""SELECT {_A}, n, CASE WHEN r <= {top} THEN path ELSE '(other)' END AS path, cast(sum(cnt) AS bigint) AS cnt, count(*) FILTER (WHERE r > {top}) AS distinct_dropped, period AS date
      FROM (SELECT *, row_number() OVER (PARTITION BY {_A}, n ORDER BY cnt DESC, path) AS r FROM (
        SELECT {_KA}, n, path, count(*) AS cnt FROM grams JOIN kept k USING (period, uuid, suid) GROUP BY ALL)) GROUP BY ALL"""


CUBE_SQL |= {"path": _paths(PATH_TOP), "path_cut": _paths(TOP)}
GRAMS = """
grams AS (
  SELECT period, uuid, suid, 3 AS n, state || '>' || n1 || '>' || n2 AS path FROM seq WHERE n2 IS NOT NULL
  UNION ALL SELECT period, uuid, suid, 4, state || '>' || n1 || '>' || n2 || '>' || n3 FROM seq WHERE n3 IS NOT NULL
  UNION ALL SELECT period, uuid, suid, 5, state || '>' || n1 || '>' || n2 || '>' || n3 || '>' || n4 FROM seq WHERE n4 IS NOT NULL)"""

QUALITY = """
q AS (SELECT event_id, uuid, suid, ts, date_id, service_code, coalesce(raw_version, 'unknown') AS app_version, action_type, action_kind, nullif(trim(action_name), '') AS name, nullif(trim(page), '') AS page FROM ev_all),
qd AS (SELECT q.*, date_id AS period FROM q WHERE date_id IN (SELECT period FROM days)),
qs AS (
  SELECT days.period, uuid, suid, first(service_code ORDER BY ts, event_id) AS service_code, first(app_version ORDER BY ts, event_id) AS app_version,
    count(*) FILTER (WHERE action_type = 'Pageview') AS pv, date_sub('second', min(ts), max(ts)) AS span, max(ts) FILTER (WHERE action_type = 'Pageview') AS last_pv,
    max(ts) FILTER (WHERE action_type = 'App' AND action_kind = 'AppExit') AS last_exit, count(*) FILTER (WHERE action_type = 'App') AS app
  FROM q JOIN days ON q.date_id IN (days.before, days.period, days.after) GROUP BY days.period, uuid, suid HAVING strftime(min(ts), '%Y-%m-%d') = days.period),
qv AS (
  SELECT service_code, app_version, period, uuid, suid, visit_idx, max(CASE WHEN action_type = 'Usage' THEN 1 ELSE 0 END) AS has_dwell FROM (
    SELECT *, sum(CASE WHEN action_type = 'Pageview' THEN 1 ELSE 0 END) OVER (PARTITION BY period, uuid, suid ORDER BY ts, action_type = 'Pageview' DESC, event_id ROWS UNBOUNDED PRECEDING) AS visit_idx
    FROM qd WHERE action_type = 'Pageview' OR (action_type = 'Usage' AND action_kind = 'UsagePage')) WHERE visit_idx > 0 GROUP BY ALL),
quality AS (
  SELECT service_code, app_version, period, 'null_action_name' AS check_name, count(*) FILTER (WHERE name IS NULL) AS violated, count(*) AS total FROM qd GROUP BY ALL
  UNION ALL SELECT service_code, app_version, period, 'pageview_null_kind', count(*) FILTER (WHERE action_type = 'Pageview' AND action_kind IS NULL), count(*) FROM qd GROUP BY ALL
  UNION ALL SELECT service_code, app_version, period, 'screen_other_ratio', count(*) FILTER (WHERE name IS NULL), count(*) FROM qd WHERE action_type = 'Pageview' GROUP BY ALL
  UNION ALL SELECT service_code, app_version, period, 'session_no_screen', count(*) FILTER (WHERE pv = 0), count(*) FROM qs GROUP BY ALL
  UNION ALL SELECT service_code, app_version, period, 'session_span_exceeds_timeout', count(*) FILTER (WHERE span > 21600), count(*) FROM qs GROUP BY ALL
  UNION ALL SELECT service_code, app_version, period, 'page_name_ambiguous', count(*) FILTER (WHERE pages > 1), count(*)
    FROM (SELECT service_code, app_version, period, name, count(DISTINCT page) AS pages FROM qd WHERE action_type = 'Pageview' AND name IS NOT NULL GROUP BY ALL) GROUP BY ALL
  UNION ALL SELECT service_code, app_version, period, 'screen_without_dwell', count(*) FILTER (WHERE has_dwell = 0), count(*) FROM qv GROUP BY ALL
  UNION ALL SELECT service_code, app_version, period, 'exit_without_appexit', count(*) FILTER (WHERE last_exit IS NULL OR last_exit < last_pv), count(*)
    FROM qs WHERE last_pv IS NOT NULL AND app > 0 GROUP BY ALL)"""


def over(*cubes: str, ctes: str = "", select: str, recursive: bool = False) -> str:
    """``select`` over the named cubes (as CTEs c_<name>) and over all steps before them."""
    parts = [BASE, DICTS, KEPT]
    if set(cubes) & {"transition", "action", "cond_transition", "path", "path_cut", "visits"}:
        parts.append(VISITS)
    if {"path", "path_cut"} & set(cubes):
        parts.append(GRAMS)
    if "quality" in cubes:
        parts.append(QUALITY)
    parts += [f"\nc_{c} AS MATERIALIZED ({CUBE_SQL[c]})" for c in cubes if c in CUBE_SQL]
    if "quality" in cubes:
        parts.append("\nc_quality AS MATERIALIZED (SELECT *, period AS date FROM quality)")
    if ctes:
        parts.append(ctes)
    return f"WITH {'RECURSIVE' if recursive else ''} {','.join(parts)}\n{select}"


def r(x: str) -> str:
    """A double to six decimals."""
    return f"round(cast({x} AS double), 6)"


SERVICE = "CASE WHEN {0} NOT IN ('START', 'EXIT') AND {0} LIKE '%/%' THEN split_part({0}, '/', 1) END"
FROM_SERVICE, TO_SERVICE = SERVICE.format("from_state"), SERVICE.format("to_state")
ON_SCREEN = "from_state NOT IN ('START', 'EXIT')"
EDGES = "e AS (SELECT from_state, to_state, cast(sum(cnt) AS bigint) AS cnt FROM c_transition WHERE cnt > 0 GROUP BY ALL), p AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY from_state) AS prob FROM e)"
STATES = "st AS (SELECT from_state AS state FROM e UNION SELECT to_state FROM e), sc AS (SELECT state FROM st WHERE state NOT IN ('START', 'EXIT'))"
