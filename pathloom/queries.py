"""Every operator of the session-path engine as a query over a data folder.

Queries of events, vocabularies and cubes compute from the raw tables each time.
Analyses, as in use, read cubes that have been built: those of a folder are
built once a session and kept on shared storage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom import oracles as O
from pathloom.analyses import CubeSet, base
from pathloom.functions import columns as C
from pathloom.operators import frames, markov, measures, segments
from pathloom.plans import cubes as K
from pathloom.plans import sessions as S
from pathloom.plans import vocabulary as V
from pathloom.sources import events as E
from pathloom.storage import discard, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DAYS = E.days_between(E.FLAT_FIRST, E.FLAT_LAST)
HOLIDAYS = ("2024-01-01", "2024-01-15")


def query(name: str, oracle: str | None = None):
    def wrap(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return wrap


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, for comparison."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), 6).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema])


@dataclass
class Workspace:
    """Events, vocabulary and cubes of a folder."""

    spark: SparkSession
    folder: str

    def _made_of(self) -> tuple:
        """The session, and name, size and time of every file of the tables: other files, other cubes."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        found = []
        for table in ("events", "customer"):
            todo = [fs.Path(f"{self.folder}/{table}.parquet")]
            at = todo[0].getFileSystem(self.spark._jsc.hadoopConfiguration())
            while todo:
                for s in at.listStatus(todo.pop()):
                    if s.isDirectory():
                        todo.append(s.getPath())
                    else:
                        found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return self.spark.sparkContext.applicationId, self.folder, tuple(sorted(found))

    def events(self) -> DataFrame:
        return E.flat_events(self.spark, self.folder, DAYS)

    def vocabulary(self, events: DataFrame | None = None) -> V.StateDict:
        key = ("vocabulary", *self._made_of())
        if key not in _kept:
            events = events if events is not None else self.events()
            _kept[key] = V.build(events.where(F.col("date_id").isin(*DAYS)), min_count=1)
        return _kept[key]

    def marked(self) -> DataFrame:
        events = self.events()
        return S.marked(events, DAYS, self.vocabulary(events))

    def cube(self, name: str) -> DataFrame:
        events = self.events()
        return K.build(name, events, DAYS, self.vocabulary(events), top=O.TOP)

    def cubes(self) -> CubeSet:
        key = ("cubes", *self._made_of())
        if key not in _kept:
            events = self.events()
            v = self.vocabulary(events)
            rows = stored(S.marked(events, DAYS, v), "marked")
            visits = stored(S.visit_rows(rows), "visits")
            made = {n: stored(K.build(n, events, DAYS, v, rows, visits=visits), f"cube-{n}") for n in K.CUBES}
            discard(rows, visits)
            _kept[key] = CubeSet(**made, state_dict_version=v.version(), services=E.FLAT_SERVICES, requested_dates=tuple(DAYS), present_dates=tuple(DAYS))
        return _kept[key]


_kept: dict[tuple, object] = {}


def _frame(name: str, headline: bool = False, **params) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        plan = base.get(name)(Workspace(spark, folder).cubes(), (), **params)
        return rounded(plan.headline.drop("error") if headline else plan.frame)

    return run


def analysis_query(name: str, of: str, oracle: str | None = None, headline: bool = False, **params) -> None:
    query(name, oracle)(_frame(of, headline, **params))


# ---------------------------------------------------------------- events and vocabularies

_EV = f"WITH {O.BASE}"


@query("canonical_events", f"{_EV} SELECT event_id, uuid, suid, ts, date_id, action_type, action_kind, action_name, service_code, page, layer1, layer2, {O.r('usage_duration_ms')} AS usage_duration_ms, raw_version, is_valid FROM ev_all")
def canonical_events(spark, folder):
    rows = Workspace(spark, folder).events()
    return rounded(rows.select("event_id", "uuid", "suid", "ts", "date_id", "action_type", "action_kind", "action_name", "service_code", "page", "layer1", "layer2", "usage_duration_ms", "raw_version", "is_valid"))


@query("axis_projection", f"{_EV} SELECT event_id, service_type, os, gender, age_band, daypart FROM ev_all")
def axis_projection(spark, folder):
    return Workspace(spark, folder).events().select("event_id", "service_type", "os", "gender", "age_band", "daypart")


@query("base_filters", f"{_EV} SELECT date_id, service_code, count(*) AS events FROM ev GROUP BY ALL")
def base_filters(spark, folder):
    return E.valid(Workspace(spark, folder).events()).groupBy("date_id", "service_code").agg(F.count(F.lit(1)).alias("events"))


@query("demography_left_join", f"{_EV} SELECT gender, age_band, count(*) AS events, count(DISTINCT uuid) AS users FROM ev GROUP BY ALL")
def demography_left_join(spark, folder):
    return E.valid(Workspace(spark, folder).events()).groupBy("gender", "age_band").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("uuid").alias("users"))


def _dictionary(kind: str) -> Query:
    def run(spark, folder):
        events = Workspace(spark, folder).events().where(F.col("date_id").isin(*DAYS))
        return V.cut(V.counts(events, kind), min_count=1, most=V.MOST_VERSIONS if kind == "versions" else None).withColumn("rank", F.col("rank").cast("long"))

    return run


for _kind in V.KINDS:
    query(f"dict_{_kind}", f"WITH {O.BASE}, {O._dict(_kind)} SELECT value, cnt, rank FROM d_{_kind}")(_dictionary(_kind))


@query("dict_screens_approx")
def dict_screens_approx(spark, folder):
    return V.counts(Workspace(spark, folder).events(), "screens", exact=False)


@query("dict_screens_approx_error", f"WITH {O.BASE}, {O.DICTS} SELECT value, cnt, true AS close FROM n_screens")
def dict_screens_approx_error(spark, folder):
    """Exact counts, and whether the approximate ones are within four times their relative deviation."""
    events = Workspace(spark, folder).events().where(F.col("date_id").isin(*DAYS))
    near = V.counts(events, "screens", exact=False, rsd=0.023).withColumnRenamed("cnt", "near")
    return V.counts(events, "screens").join(near, "value").select("value", "cnt", (F.abs(F.col("near") - F.col("cnt")) <= 4 * 0.023 * F.col("cnt") + 1).alias("close"))


# ---------------------------------------------------------------- sessions and visits

_AXES = ", ".join(C.AXES)


@query("session_attribution", O.over(select=f"SELECT uuid, suid, {_AXES}, events, pv, duration_sec FROM kept"))
def session_attribution(spark, folder):
    return S.session_rows(Workspace(spark, folder).marked()).drop("build_day")


@query("visit_index", O.over("visits", select="SELECT m.period, m.event_id, cast(m.visit_idx AS bigint) AS visit_idx FROM marked m SEMI JOIN kept USING (period, uuid, suid)"))
def visit_index(spark, folder):
    return Workspace(spark, folder).marked().select("period", "event_id", "visit_idx")


@query("click_asof_screen", O.over("visits", select="SELECT k.period, uuid, suid, cast(visit_idx AS bigint) AS visit_idx, screen, action_kind FROM clicks JOIN kept k USING (period, uuid, suid)"))
def click_asof_screen(spark, folder):
    rows = Workspace(spark, folder).marked().where("is_click")
    return rows.select("period", "uuid", "suid", "visit_idx", F.coalesce("at_state", F.lit(C.START)).alias("screen"), F.col("kind").alias("action_kind"))


@query("start_edges", O.over("visits", select="SELECT period, to_state, count(*) AS cnt FROM edges JOIN kept USING (period, uuid, suid) WHERE from_state = 'START' GROUP BY ALL"))
def start_edges(spark, folder):
    edges = S.edge_rows(S.visit_rows(Workspace(spark, folder).marked()))
    return edges.where(F.col("from_state") == C.START).groupBy("period", "to_state").agg(F.count(F.lit(1)).alias("cnt"))


@query("dwell_per_visit", O.over("visits", select=f"SELECT period, uuid, suid, cast(visit_idx AS bigint) AS visit_idx, state, {O.r('dwell')} AS dwell FROM seq"))
def dwell_per_visit(spark, folder):
    return rounded(S.visit_rows(Workspace(spark, folder).marked()).select("period", "uuid", "suid", "visit_idx", "state", "dwell"))


@query("no_click_anti_join", O.over("visits", select="SELECT k.period, from_state, to_state, count(*) AS cnt FROM (SELECT * FROM edges ANTI JOIN clicks USING (period, uuid, suid, visit_idx)) e JOIN kept k USING (period, uuid, suid) GROUP BY ALL"))
def no_click_anti_join(spark, folder):
    rows = Workspace(spark, folder).marked()
    edges = S.edge_rows(S.visit_rows(rows))
    quiet = edges.join(rows.where("is_click").select(*S.SESSION, "visit_idx"), [*S.SESSION, "visit_idx"], "left_anti")
    return quiet.groupBy("period", "from_state", "to_state").agg(F.count(F.lit(1)).alias("cnt"))


def _ngrams(n: int) -> Query:
    def run(spark, folder):
        return S_grams(spark, folder).where(F.col("n") == n).groupBy("path").agg(F.count(F.lit(1)).alias("cnt"))

    return run


def S_grams(spark, folder):
    return K.ngram_rows(S.visit_rows(Workspace(spark, folder).marked()))


for _n in K.PATH_LENGTHS:
    query(f"ngrams_{_n}", O.over("visits", ctes=O.GRAMS, select=f"SELECT path, count(*) AS cnt FROM grams WHERE n = {_n} GROUP BY path"))(_ngrams(_n))


@query("path_topn_residual", O.over("visits", ctes=O.GRAMS, select="""SELECT n, CASE WHEN r <= 20 THEN path ELSE '(other)' END AS path, cast(sum(cnt) AS bigint) AS cnt, count(*) FILTER (WHERE r > 20) AS distinct_dropped
  FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, path) AS r FROM (SELECT n, path, count(*) AS cnt FROM grams GROUP BY ALL)) GROUP BY ALL"""))
def path_topn_residual(spark, folder):
    return K.top_with_rest(S_grams(spark, folder).groupBy("n", "path").agg(F.count(F.lit(1)).alias("cnt")), ["n"], "path", 20)


# ---------------------------------------------------------------- cubes


def _cube(name: str) -> Query:
    return lambda spark, folder: rounded(Workspace(spark, folder).cube(name))


for _c in K.CUBES:
    _select = f"SELECT * REPLACE ({O.r('dur_sum')} AS dur_sum) FROM c_transition" if _c == "transition" else f"SELECT * FROM c_{_c}{'_cut' * (_c == 'path')}"
    query(f"cube_{_c}", O.over("path_cut" if _c == "path" else _c, select=_select))(_cube(_c))


def _check(name: str) -> Query:
    return lambda spark, folder: Workspace(spark, folder).cube("quality").where(F.col("check_name") == name)


for _c in K.CHECKS:
    query(f"check_{_c}", O.over("quality", select=f"SELECT * FROM c_quality WHERE check_name = '{_c}'"))(_check(_c))


@query("session_rollup_period", O.over(select="SELECT period, count(*) AS sessions, count(DISTINCT uuid) AS uv, cast(sum(pv) AS bigint) AS pv FROM kept GROUP BY period"))
def session_rollup_period(spark, folder):
    return frames.rollup_rows(Workspace(spark, folder).cube("session"), C.AXES[1:]).select("period", "sessions", "uv", "pv")


@query("session_full_combination", O.over(select=f"SELECT {_AXES}, count(*) AS sessions, count(DISTINCT uuid) AS uv FROM kept GROUP BY ALL"))
def session_full_combination(spark, folder):
    return frames.full_rows(Workspace(spark, folder).cube("session")).select(*C.AXES, "sessions", "uv")


# ---------------------------------------------------------------- sessions

_TREND = f"""SELECT period, count(*) AS sessions, count(DISTINCT uuid) AS uv, cast(sum(pv) AS bigint) AS pv, cast(sum(events) AS bigint) AS events, cast(sum(duration_sec) AS bigint) AS duration_sum,
  {O.r('count(*) / count(DISTINCT uuid)')} AS sessions_per_user, {O.r('sum(pv) / count(*)')} AS pv_per_session, {O.r('sum(duration_sec) / count(*)')} AS seconds_per_session, '{measures.DWELL_DEFINITION}' AS dwell_definition,
  CASE WHEN period IN ('2024-01-01', '2024-01-15') THEN 'holiday' WHEN dayofweek(cast(period AS date)) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_kind FROM kept GROUP BY period"""
analysis_query("session_trend", "session_trend", O.over(select=_TREND), holidays=HOLIDAYS)
analysis_query("session_trend_headline", "session_trend", O.over(select=f"SELECT cast(count(*) AS double) AS sessions, {O.r('sum(pv) / count(*)')} AS pv_per_session, {O.r('sum(duration_sec) / count(*)')} AS seconds_per_session FROM kept"), headline=True)


@query("session_trend_segment", O.over(select=f"SELECT period, count(*) AS sessions, cast(NULL AS bigint) AS uv, cast(sum(pv) AS bigint) AS pv, {O.r('sum(pv) / count(*)')} AS pv_per_session FROM kept WHERE os = 'android' GROUP BY period"))
def session_trend_segment(spark, folder):
    cubes = Workspace(spark, folder).cubes().filter(os="android")
    return rounded(base.get("session_trend")(cubes, ()).frame.select("period", "sessions", "uv", "pv", "pv_per_session"))


@query("uv_pv", O.over(select="SELECT period, os, count(DISTINCT uuid) AS uv, cast(sum(pv) AS bigint) AS pv, count(*) AS sessions FROM kept GROUP BY GROUPING SETS ((period))".replace(", os", "")))
def uv_pv(spark, folder):
    return measures.uv_pv(Workspace(spark, folder).cubes().session, C.AXES[1:]).select("period", "uv", "pv", "sessions")


@query("engagement", O.over(select=f"SELECT period, {O.r('count(*) / count(DISTINCT uuid)')} AS sessions_per_user, {O.r('sum(pv) / count(*)')} AS pv_per_session, {O.r('sum(duration_sec) / count(*)')} AS seconds_per_session, '{measures.DWELL_DEFINITION}' AS dwell_definition FROM kept GROUP BY period"))
def engagement(spark, folder):
    return rounded(measures.engagement(Workspace(spark, folder).cubes().session, C.AXES[1:]))


@query("day_kind_split", O.over(select="SELECT CASE WHEN period IN ('2024-01-01', '2024-01-15') THEN 'holiday' WHEN dayofweek(cast(period AS date)) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_kind, count(DISTINCT period) AS days, count(*) AS sessions FROM kept GROUP BY 1"))
def day_kind_split(spark, folder):
    rows = frames.rollup_rows(Workspace(spark, folder).cubes().session, C.AXES[1:])
    return rows.groupBy(C.day_kind(F.col("period"), HOLIDAYS).alias("day_kind")).agg(F.count_distinct("period").alias("days"), F.sum("sessions").alias("sessions"))


@query("demography_coverage", O.over(select=f"SELECT {O.r('count(*) FILTER (WHERE gender <> $$unknown$$) / count(*)')} AS gender, {O.r('count(*) FILTER (WHERE age_band <> $$unknown$$) / count(*)')} AS age_band FROM kept"))
def demography_coverage(spark, folder):
    return rounded(measures.demography_coverage(Workspace(spark, folder).cubes().session))


# ---------------------------------------------------------------- screens and chains

_ON = O.ON_SCREEN
analysis_query("screen_dwell_rank", "screen_dwell_rank", O.over("transition", select=f"""SELECT from_state AS state, cast(sum(cnt) AS bigint) AS visits, cast(sum(dur_n) AS bigint) AS measured_visits, {O.r('sum(dur_sum)')} AS seconds,
  {O.r('CASE WHEN sum(dur_n) > 0 THEN sum(dur_sum) / sum(dur_n) END')} AS seconds_per_visit, {O.r('sum(dur_n) / sum(cnt)')} AS coverage FROM c_transition WHERE {_ON} GROUP BY 1"""))
analysis_query("screen_dwell_headline", "screen_dwell_rank", O.over("transition", select=f"SELECT {O.r('sum(dur_sum) / sum(dur_n)')} AS mean_seconds_per_visit, {O.r('sum(dur_n) / sum(cnt)')} AS dwell_coverage FROM c_transition WHERE {_ON}"), headline=True)


@query("dwell_coverage", O.over("transition", select=f"SELECT {O.r('sum(dur_n) / sum(cnt)')} AS dwell_coverage FROM c_transition WHERE {_ON}"))
def dwell_coverage(spark, folder):
    return rounded(measures.dwell_coverage(Workspace(spark, folder).cubes().transition))


analysis_query("screen_transition", "screen_transition", O.over("transition", ctes=O.EDGES, select=f"SELECT from_state, to_state, {O.r('prob')} AS prob, cnt FROM p"))
analysis_query("screen_transition_headline", "screen_transition", O.over("transition", ctes=O.EDGES + ", " + O.STATES, select="SELECT cast((SELECT count(*) FROM e) AS double) AS pairs, cast((SELECT count(*) FROM st) AS double) AS states"), headline=True)


@query("exit_probabilities", O.over("transition", ctes=O.EDGES + ", " + O.STATES, select=f"SELECT state, {O.r('coalesce(prob, 0)')} AS exit_prob FROM sc LEFT JOIN (SELECT * FROM p WHERE to_state = 'EXIT') x ON x.from_state = sc.state"))
def exit_probabilities(spark, folder):
    return rounded(markov.exit_probabilities(Workspace(spark, folder).cubes().transition))


@query("determinism", O.over("transition", ctes=O.EDGES + ", " + O.STATES, select=f"""SELECT state, {O.r('-sum(prob * ln(prob))')} AS entropy, {O.r('sum(prob * prob)')} AS hhi, {O.r('max(prob)')} AS top_p, {O.r('exp(-sum(prob * ln(prob)))')} AS effective_choices, count(prob) AS out_degree,
  first(to_state ORDER BY cnt DESC, CASE to_state WHEN 'START' THEN 0 WHEN 'EXIT' THEN 2 ELSE 1 END, to_state) AS top_to FROM sc LEFT JOIN p ON p.from_state = sc.state GROUP BY state"""))
def determinism(spark, folder):
    return rounded(markov.determinism(Workspace(spark, folder).cubes().transition))


_PMI = "SELECT from_state, to_state, cnt, cnt / sum(cnt) OVER () AS joint, ln((cnt / sum(cnt) OVER ()) / ((sum(cnt) OVER (PARTITION BY from_state) / sum(cnt) OVER ()) * (sum(cnt) OVER (PARTITION BY to_state) / sum(cnt) OVER ()))) AS pmi FROM e"
analysis_query("pmi", "screen_pair_affinity", O.over("transition", ctes=O.EDGES, select=f"SELECT from_state, to_state, cnt, {O.r('pmi')} AS pmi FROM ({_PMI})"))
analysis_query("mutual_information", "screen_pair_affinity", O.over("transition", ctes=O.EDGES, select=f"SELECT {O.r('sum(joint * pmi)')} AS mutual_information, cast(count(*) AS double) AS pairs FROM ({_PMI})"), headline=True)

_HUB = "top/s1"
_NEAR = f"""SELECT '{_HUB}' AS hub, direction, neighbor, cnt, {O.r('cnt / sum(cnt) OVER (PARTITION BY direction)')} AS share FROM (
  SELECT 'OUT' AS direction, to_state AS neighbor, cnt FROM e WHERE from_state = '{_HUB}' UNION ALL SELECT 'IN', from_state, cnt FROM e WHERE to_state = '{_HUB}')"""
analysis_query("hub_neighbors", "hub_neighbors", O.over("transition", ctes=O.EDGES, select=_NEAR), screen=_HUB)

# Chances of being at the target after k steps, the target keeping what gets there: k joins, spelled out by recursion.
_HIT = """, step(k, state, mass) AS (
  SELECT 0, '{source}', cast(1.0 AS double)
  UNION ALL SELECT k + 1, to_state, sum(mass * prob) FROM (
    SELECT step.k, coalesce(q.to_state, step.state) AS to_state, step.mass, coalesce(q.prob, 1.0) AS prob
    FROM step LEFT JOIN (SELECT * FROM p WHERE from_state <> '{target}') q ON q.from_state = step.state WHERE step.k < {most}) GROUP BY k, to_state)"""
_PATH_TO = ("top/s1", "media/s1", 10)
analysis_query("reachability", "reachability", O.over("transition", recursive=True, ctes=O.EDGES + _HIT.format(source=_PATH_TO[0], target=_PATH_TO[1], most=_PATH_TO[2]), select=f"SELECT '{_PATH_TO[0]}' AS source, '{_PATH_TO[1]}' AS target, k, {O.r('mass')} AS p_hit_within FROM step WHERE state = '{_PATH_TO[1]}' AND k > 0"), source=_PATH_TO[0], target=_PATH_TO[1], max_k=_PATH_TO[2])

# All screens at once: the chance of having left within k steps.
_OUT = """, gone(k, origin, state, mass) AS (
  SELECT 0, state, state, cast(1.0 AS double) FROM sc
  UNION ALL SELECT k + 1, origin, to_state, sum(mass * prob) FROM (
    SELECT gone.k, gone.origin, coalesce(q.to_state, gone.state) AS to_state, gone.mass, coalesce(q.prob, 1.0) AS prob
    FROM gone LEFT JOIN (SELECT * FROM p WHERE from_state <> 'EXIT') q ON q.from_state = gone.state WHERE gone.k < {most}) GROUP BY k, origin, to_state)"""


@query("p_exit_within", O.over("transition", recursive=True, ctes=f"{O.EDGES}, {O.STATES}{_OUT.format(most=3)}", select=f"SELECT origin AS state, {O.r('mass')} AS p_exit_within_3 FROM gone WHERE k = 3 AND state = 'EXIT'"))
def p_exit_within(spark, folder):
    return rounded(markov.flow(Workspace(spark, folder).cubes().transition, exit_within=(3,)).select("state", "p_exit_within_3"))


# Expected steps: the mass still inside, summed over enough steps to be exact to the digits shown.
@query("expected_steps", O.over("transition", recursive=True, ctes=f"{O.EDGES}, {O.STATES}{_OUT.format(most=400)}", select="SELECT origin AS state, round(sum(mass), 4) AS expected_steps FROM gone WHERE state <> 'EXIT' AND k < 400 GROUP BY origin"))
def expected_steps(spark, folder):
    return markov.flow(Workspace(spark, folder).cubes().transition).select("state", F.round("expected_steps", 4).alias("expected_steps"))


@query("absorption", O.over("transition", recursive=True, ctes=f"{O.EDGES}, {O.STATES}{_OUT.format(most=400)}", select="SELECT origin AS state, round(mass, 4) AS p_reach_exit FROM gone WHERE state = 'EXIT' AND k = 400"))
def absorption(spark, folder):
    return markov.flow(Workspace(spark, folder).cubes().transition).select("state", F.round("p_reach_exit", 4).alias("p_reach_exit"))


# Walks among the screens alone, with their rows summing to one again.
_INNER = ", inner_p AS (SELECT from_state, to_state, cnt / sum(cnt) OVER (PARTITION BY from_state) AS prob FROM e WHERE from_state NOT IN ('START', 'EXIT') AND to_state NOT IN ('START', 'EXIT'))"
_WALK = """, {name}(k, state, mass) AS (
  SELECT 0, state, cast(1.0 AS double) / (SELECT count(*) FROM sc) FROM sc
  UNION ALL SELECT k + 1, sc.state, {extra} coalesce(flow.mass, 0) FROM (SELECT DISTINCT k FROM {name} WHERE k < 200) s CROSS JOIN sc
    LEFT JOIN (SELECT to_state, sum({name}.mass * prob) AS mass FROM {name} JOIN inner_p ON from_state = {name}.state GROUP BY to_state) flow ON flow.to_state = sc.state)"""
_STAY = _WALK.format(name="stay", extra="")
_RANK = _WALK.format(name="rank", extra="0.15 / (SELECT count(*) FROM sc) + 0.85 *")


@query("stationary", O.over("transition", recursive=True, ctes=f"{O.EDGES}, {O.STATES}{_INNER}{_STAY}", select="SELECT state, round(mass, 4) AS pi FROM stay WHERE k = 200"))
def stationary(spark, folder):
    return markov.flow(Workspace(spark, folder).cubes().transition).select("state", F.round("pi", 4).alias("pi"))


@query("pagerank", O.over("transition", recursive=True, ctes=f"{O.EDGES}, {O.STATES}{_INNER}{_RANK}", select="SELECT state, round(mass, 4) AS pagerank FROM rank WHERE k = 200"))
def pagerank(spark, folder):
    return markov.flow(Workspace(spark, folder).cubes().transition).select("state", F.round("pagerank", 4).alias("pagerank"))


_FLOW_CTES = f"""{O.EDGES}, {O.STATES}{_OUT.format(most=400)}{_INNER}{_STAY}{_RANK},
fl AS (
  SELECT sc.state, coalesce(x.prob, 0) AS exit_prob, stay.mass AS pi, (SELECT sum(mass) FROM gone WHERE origin = sc.state AND gone.state <> 'EXIT' AND k < 400) AS expected_steps,
    (SELECT mass FROM gone WHERE origin = sc.state AND gone.state = 'EXIT' AND k = 400) AS p_reach_exit, (SELECT mass FROM gone WHERE origin = sc.state AND gone.state = 'EXIT' AND k = 3) AS p_exit_within_3,
    rank.mass AS pagerank, cast(coalesce(v.cnt, 0) AS double) AS visits
  FROM sc LEFT JOIN (SELECT * FROM p WHERE to_state = 'EXIT') x ON x.from_state = sc.state JOIN stay ON stay.k = 200 AND stay.state = sc.state JOIN rank ON rank.k = 200 AND rank.state = sc.state
    LEFT JOIN (SELECT from_state, sum(cnt) AS cnt FROM e GROUP BY 1) v ON v.from_state = sc.state),
dt AS (SELECT from_state AS state, -sum(prob * ln(prob)) AS entropy, sum(prob * prob) AS hhi, max(prob) AS top_p, exp(-sum(prob * ln(prob))) AS effective_choices, count(*) AS out_degree,
  first(to_state ORDER BY cnt DESC, CASE to_state WHEN 'START' THEN 0 WHEN 'EXIT' THEN 2 ELSE 1 END, to_state) AS top_to FROM p GROUP BY 1),
hd AS (SELECT sum(expected_steps * visits) / sum(visits) AS mean_expected_steps, sum(exit_prob * visits) / sum(visits) AS mean_exit_prob FROM fl)"""
_FLOW_COLUMNS = ", ".join(f"{O.r(c)} AS {c}" for c in ("exit_prob", "pi", "expected_steps", "p_reach_exit", "pagerank", "visits", "p_exit_within_3", "entropy", "hhi", "top_p", "effective_choices"))
analysis_query("screen_flow", "screen_flow", O.over("transition", recursive=True, ctes=_FLOW_CTES, select=f"SELECT state, {_FLOW_COLUMNS}, coalesce(out_degree, 0) AS out_degree, top_to, {O.r('mean_exit_prob')} AS exit_baseline, {O.r('exit_prob / mean_exit_prob')} AS exit_lift FROM fl LEFT JOIN dt USING (state), hd"), exit_within=(3,))
analysis_query("screen_flow_headline", "screen_flow", O.over("transition", recursive=True, ctes=_FLOW_CTES, select=f"SELECT {O.r('mean_expected_steps')} AS mean_expected_steps, {O.r('mean_exit_prob')} AS mean_exit_prob FROM hd"), headline=True)

_TOP_HUB = f"{O.EDGES}, {O.STATES}{_INNER}{_RANK}, hub AS (SELECT state FROM rank WHERE k = 200 ORDER BY mass DESC, state LIMIT 1)"
analysis_query("hub_neighbors_auto", "hub_neighbors", O.over("transition", recursive=True, ctes=_TOP_HUB, select=_NEAR.replace(f"'{_HUB}'", "(SELECT state FROM hub)")))

analysis_query("cross_service_flow", "cross_service_flow", O.over("transition", select=f"""SELECT from_service, to_service, cast(sum(cnt) AS bigint) AS cnt, {O.r('sum(cnt) / sum(sum(cnt)) OVER (PARTITION BY from_service)')} AS share_of_origin
  FROM (SELECT {O.FROM_SERVICE} AS from_service, {O.TO_SERVICE} AS to_service, cnt FROM c_transition) WHERE from_service IS NOT NULL AND to_service IS NOT NULL GROUP BY 1, 2"""))
_SWITCH = f"x AS (SELECT a, b, sum(cnt) AS cnt FROM (SELECT {O.FROM_SERVICE} AS a, {O.TO_SERVICE} AS b, cnt FROM c_transition) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2), y AS (SELECT cnt / sum(cnt) OVER () AS p FROM x WHERE a <> b)"
analysis_query("cross_service_headline", "cross_service_flow", O.over("transition", ctes=_SWITCH, select=f"SELECT {O.r('(SELECT sum(cnt) FROM x WHERE a <> b) / (SELECT sum(cnt) FROM x)')} AS cross_service_share, {O.r('coalesce((SELECT -sum(p * ln(p)) FROM y), 0)')} AS switch_entropy"), headline=True)
_SVC = f"s AS (SELECT {O.FROM_SERVICE} AS service, from_state, cnt FROM c_transition)"


@query("service_mix", O.over("transition", ctes=_SVC, select=f"SELECT service, cast(sum(cnt) AS bigint) AS cnt, {O.r('sum(cnt) / sum(sum(cnt)) OVER ()')} AS share FROM s WHERE service IS NOT NULL GROUP BY 1"))
def service_mix(spark, folder):
    return rounded(measures.service_mix(Workspace(spark, folder).cubes().transition))


@query("other_share", O.over("transition", ctes=_SVC, select=f"SELECT service, {O.r('coalesce(sum(cnt) FILTER (WHERE from_state LIKE $$%/other$$), 0) / sum(cnt)')} AS other_share FROM s WHERE service IS NOT NULL GROUP BY 1"))
def other_share(spark, folder):
    return rounded(measures.other_share(Workspace(spark, folder).cubes().transition))


# ---------------------------------------------------------------- clicks

analysis_query("click_distribution", "click_distribution", O.over("action", select=f"SELECT screen, action_kind, cast(sum(cnt) AS bigint) AS cnt, {O.r('sum(cnt) / sum(sum(cnt)) OVER (PARTITION BY screen)')} AS share FROM c_action GROUP BY 1, 2"))
analysis_query("click_distribution_slots", "click_distribution", O.over("action", select=f"SELECT screen, layer1, layer2, cast(sum(cnt) AS bigint) AS cnt, {O.r('sum(cnt) / sum(sum(cnt)) OVER (PARTITION BY screen)')} AS share FROM c_action GROUP BY 1, 2, 3"), by=("layer1", "layer2"))
analysis_query("click_headline", "click_distribution", O.over("action", "transition", select=f"""SELECT cast(sum(cnt) AS double) AS clicks, {O.r("sum(cnt) FILTER (WHERE screen NOT IN ('START', 'EXIT')) / (SELECT sum(cnt) FROM c_transition WHERE " + _ON + ")")} AS clicks_per_visit,
  {O.r("sum(cnt) FILTER (WHERE screen IN ('START', 'EXIT')) / sum(cnt)")} AS unattributed_share FROM c_action"""), headline=True)


@query("clicks_per_visit", O.over("action", "transition", select=f"""SELECT screen, clicks, visits, {O.r('clicks / visits')} AS clicks_per_visit FROM (SELECT screen, cast(sum(cnt) AS bigint) AS clicks FROM c_action WHERE screen NOT IN ('START', 'EXIT') GROUP BY 1)
  LEFT JOIN (SELECT from_state AS screen, cast(sum(cnt) AS bigint) AS visits FROM c_transition GROUP BY 1) USING (screen)"""))
def clicks_per_visit(spark, folder):
    c = Workspace(spark, folder).cubes()
    return rounded(measures.clicks_per_visit(c.action, c.transition))


analysis_query("conditional_flow", "conditional_flow", O.over("cond_transition", select=f"SELECT from_state, action_kind, to_state, cast(sum(cnt) AS bigint) AS cnt, {O.r('sum(cnt) / sum(sum(cnt)) OVER (PARTITION BY from_state, action_kind)')} AS share_of_origin FROM c_cond_transition GROUP BY 1, 2, 3"))
# H(next | screen) - H(next | screen, kind), both weighed by counts.
_INFO = """a AS (SELECT from_state, action_kind, to_state, sum(cnt) AS cnt FROM c_cond_transition WHERE action_kind <> '(no_click)' GROUP BY 1, 2, 3),
b AS (SELECT from_state, to_state, sum(cnt) AS cnt FROM a GROUP BY 1, 2),
ha AS (SELECT sum(n * h) / sum(n) AS h FROM (SELECT from_state, action_kind, sum(cnt) AS n, -sum(q * ln(q)) AS h FROM (SELECT *, cnt / sum(cnt) OVER (PARTITION BY from_state, action_kind) AS q FROM a) GROUP BY 1, 2)),
hb AS (SELECT sum(n * h) / sum(n) AS h FROM (SELECT from_state, sum(cnt) AS n, -sum(q * ln(q)) AS h FROM (SELECT *, cnt / sum(cnt) OVER (PARTITION BY from_state) AS q FROM b) GROUP BY 1))"""
analysis_query("action_information", "conditional_flow", O.over("cond_transition", "transition", ctes=_INFO, select=f"SELECT {O.r('(SELECT h FROM hb) - (SELECT h FROM ha)')} AS action_information, {O.r('(SELECT sum(cnt) FROM c_cond_transition WHERE action_kind = $$(no_click)$$) / (SELECT sum(cnt) FROM c_transition)')} AS no_click_share"), headline=True)

# ---------------------------------------------------------------- paths

analysis_query("path_ranking", "path_ranking", O.over("path", select=f"SELECT * FROM (SELECT path, cast(sum(cnt) AS bigint) AS cnt, {O.r('sum(cnt) / sum(sum(cnt)) OVER ()')} AS share FROM c_path WHERE n = 3 GROUP BY 1) WHERE path <> '(other)'"), n=3)
analysis_query("path_ranking_headline", "path_ranking", O.over("path", ctes="t AS (SELECT path, sum(cnt) AS cnt, sum(distinct_dropped) AS dd FROM c_path WHERE n = 4 GROUP BY 1)", select=f"""SELECT cast(4 AS double) AS n, {O.r("1 - coalesce(sum(cnt) FILTER (WHERE path = '(other)'), 0) / sum(cnt)")} AS coverage,
  cast(sum(dd) AS double) AS distinct_dropped, cast(count(*) FILTER (WHERE path <> '(other)') AS double) AS paths, {O.r("max(cnt) FILTER (WHERE path <> '(other)') / sum(cnt)")} AS top_path_share FROM t"""), headline=True, n=4)
_ORDER = """f AS (SELECT from_state AS cur, to_state AS nx, sum(cnt) / sum(sum(cnt)) OVER (PARTITION BY from_state) AS first FROM c_transition GROUP BY 1, 2),
g AS (SELECT prev, cur, nx, cnt, sum(cnt) OVER (PARTITION BY prev, cur) AS total, cnt / sum(cnt) OVER (PARTITION BY prev, cur) AS q, first FROM (
  SELECT split_part(path, '>', 1) AS prev, split_part(path, '>', 2) AS cur, split_part(path, '>', 3) AS nx, sum(cnt) AS cnt FROM c_path WHERE n = 3 AND path <> '(other)' GROUP BY 1, 2, 3) LEFT JOIN f USING (cur, nx)),
ctx AS (SELECT prev, cur, sum(cnt) AS cnt, sum(q * ln(q / first)) FILTER (WHERE first > 0) AS kl FROM g WHERE cur IN (SELECT cur FROM f) GROUP BY 1, 2)"""
_COVER = "(SELECT 1 - coalesce(sum(cnt) FILTER (WHERE path = '(other)'), 0) / sum(cnt) FROM c_path WHERE n = {0})"
analysis_query("markov_order_test", "markov_order_test", O.over("path", "transition", ctes=_ORDER, select=f"SELECT prev AS prev_state, cur AS state, cast(cnt AS bigint) AS cnt, {O.r('kl')} AS divergence FROM ctx"))
analysis_query("markov_order_headline", "markov_order_test", O.over("path", "transition", ctes=_ORDER, select=f"""SELECT {O.r('sum(kl * cnt) / sum(cnt)')} AS excess_information, cast(count(*) AS double) AS contexts, {O.r(_COVER.format(3))} AS coverage,
  {O.r('coalesce(sum(cnt) FILTER (WHERE kl > 0.1), 0) / sum(cnt)')} AS diverging_context_share FROM ctx"""), headline=True)
_FLOW2 = _ORDER + """, r2 AS (SELECT *, row_number() OVER (PARTITION BY prev, cur ORDER BY cnt DESC, nx) AS rs, row_number() OVER (PARTITION BY prev, cur ORDER BY first DESC NULLS LAST, nx) AS rf FROM g),
c2 AS (SELECT prev || '>' || cur AS context, cast(sum(cnt) AS bigint) AS cnt, max(CASE WHEN rf = 1 AND first IS NOT NULL THEN nx END) AS top1_next, max(CASE WHEN rs = 1 THEN nx END) AS top_order_next,
  sum(q * ln(q / first)) FILTER (WHERE first > 0) AS kl FROM r2 GROUP BY prev, cur)"""
analysis_query("markov_order_flow", "markov_order_flow", O.over("path", "transition", ctes=_FLOW2, select=f"SELECT context, cnt, top1_next, top_order_next, coalesce(top1_next <> top_order_next, false) AS argmax_flips, {O.r('kl')} AS divergence FROM c2 WHERE cnt >= 5"), min_context=5)
analysis_query("markov_order_flow_headline", "markov_order_flow", O.over("path", "transition", ctes=_FLOW2, select=f"""SELECT cast(2 AS double) AS "order", {O.r('sum(kl * cnt) / sum(cnt)')} AS excess_information,
  {O.r('coalesce(sum(cnt) FILTER (WHERE top1_next <> top_order_next), 0) / sum(cnt)')} AS flip_share, cast(count(*) FILTER (WHERE cnt >= 5) AS double) AS contexts, {O.r(_COVER.format(3))} AS coverage FROM c2"""), headline=True, min_context=5)
_FLOW3 = _FLOW2.replace("split_part(path, '>', 1) AS prev, split_part(path, '>', 2) AS cur, split_part(path, '>', 3) AS nx", "split_part(path, '>', 1) || '>' || split_part(path, '>', 2) AS prev, split_part(path, '>', 3) AS cur, split_part(path, '>', 4) AS nx").replace("n = 3", "n = 4")
analysis_query("markov_order3_flow", "markov_order_flow", O.over("path", "transition", ctes=_FLOW3, select=f"SELECT context, cnt, top1_next, top_order_next, coalesce(top1_next <> top_order_next, false) AS argmax_flips, {O.r('kl')} AS divergence FROM c2 WHERE cnt >= 2"), order=3, min_context=2)
analysis_query("screen_communities", "screen_communities")
analysis_query("community_paths", "community_paths")

# SQL has no search for communities; what is measured on a given split of the screens it has: here their services, without unlisted screens.
_SPLIT = f"sp AS (SELECT DISTINCT state, {O.SERVICE.format('state')} AS community FROM (SELECT from_state AS state FROM c_transition UNION ALL SELECT to_state FROM c_transition) WHERE state LIKE '%/%' AND state NOT LIKE '%/other')"


def _by_service(edges: DataFrame) -> DataFrame:
    """state and its service as its community."""
    return markov.screens(edges).select("state", C.service_of(F.col("state")).alias("community")).where(F.col("community").isNotNull() & ~C.is_lumped(F.col("state")))


@query("modularity_of_services", O.over("transition", ctes=f"""{_SPLIT},
w AS (SELECT a.community AS a, b.community AS b, cast(cnt AS double) AS w FROM c_transition JOIN sp a ON a.state = from_state JOIN sp b ON b.state = to_state),
c AS (SELECT a AS community, sum(w) AS deg FROM (SELECT a, w FROM w UNION ALL SELECT b, w FROM w) GROUP BY 1)""", select=f"SELECT {O.r('(SELECT sum(w) FROM w WHERE a = b) / (SELECT sum(w) FROM w) - sum(power(deg / (SELECT 2 * sum(w) FROM w), 2))')} AS modularity FROM c"))
def modularity_of_services(spark, folder):
    edges = Workspace(spark, folder).cubes().transition
    return rounded(measures.modularity(edges, _by_service(edges)))


@query("paths_within_services", O.over("transition", "path", ctes=f"""{_SPLIT},
five AS (SELECT path, sum(cnt) AS cnt, string_split(path, '>') AS steps FROM c_path WHERE n = 5 AND path <> '(other)' GROUP BY path),
kin AS (SELECT path, cnt, min(community) AS community FROM (SELECT path, cnt, unnest(steps) AS state FROM five) LEFT JOIN sp USING (state) GROUP BY path, cnt HAVING count(community) = 5 AND min(community) = max(community))""",
    select=f"SELECT community, row_number() OVER (PARTITION BY community ORDER BY cnt DESC, path) AS rank, path, cast(cnt AS bigint) AS cnt, {O.r('cnt / sum(cnt) OVER (PARTITION BY community)')} AS support_in_comm FROM kin"))
def paths_within_services(spark, folder):
    c = Workspace(spark, folder).cubes()
    return rounded(measures.paths_within(c.path, _by_service(c.transition)))

# ---------------------------------------------------------------- quality

analysis_query("quality_report", "quality_report", O.over("quality", select=f"SELECT check_name, period, cast(sum(violated) AS bigint) AS violated, cast(sum(total) AS bigint) AS total, {O.r('sum(violated) / sum(total)')} AS ratio FROM c_quality GROUP BY 1, 2"))
_WORST = ", ".join(f"{O.r(f'max(ratio) FILTER (WHERE check_name = $${c}$$)')} AS worst_{c}" for c in K.CHECKS)
analysis_query("quality_headline", "quality_report", O.over("quality", ctes="z AS (SELECT check_name, period, sum(violated) AS violated, sum(total) AS total, sum(violated) / sum(total) AS ratio FROM c_quality GROUP BY 1, 2)", select=f"SELECT {_WORST}, {O.r('1 - sum(violated) FILTER (WHERE check_name = $$exit_without_appexit$$) / sum(total) FILTER (WHERE check_name = $$exit_without_appexit$$)')} AS exit_corroboration FROM z"), headline=True)
_LIMITS = {"session_no_screen": 0.15, "screen_without_dwell": 0.5, "session_span_exceeds_timeout": 0.01}
_VALUES = ", ".join(f"('{k}', cast({v} AS double))" for k, v in _LIMITS.items())


@query("quality_warnings", O.over("quality", select=f"""SELECT check_name, service_code, period, cast(sum(violated) AS bigint) AS violated, cast(sum(total) AS bigint) AS total, {O.r('sum(violated) / sum(total)')} AS ratio, any_value(l) AS "limit"
  FROM c_quality JOIN (VALUES {_VALUES}) v(check_name, l) USING (check_name) GROUP BY 1, 2, 3 HAVING sum(violated) / sum(total) > any_value(l)"""))
def quality_warnings(spark, folder):
    return rounded(measures.quality_warnings(Workspace(spark, folder).cubes().quality, _LIMITS))


@query("screen_coverage", O.over("quality", select=f"SELECT {O.r('1 - sum(violated) / sum(total)')} AS screen_coverage FROM c_quality WHERE check_name = 'session_no_screen'"))
def screen_coverage(spark, folder):
    return rounded(measures.screen_coverage(Workspace(spark, folder).cubes().quality))


# ---------------------------------------------------------------- comparisons

_AB = ("app_version", "2.0", "1.0")
_DAYS_AB = "d AS (SELECT period FROM c_transition WHERE app_version IN ('1.0', '2.0') GROUP BY period HAVING count(DISTINCT app_version) = 2)"


@query("comparable_dates", O.over("transition", ctes=_DAYS_AB, select="SELECT period FROM d"))
def comparable_dates(spark, folder):
    days = measures.comparable_days(Workspace(spark, folder).cubes().transition, *_AB)
    return spark.createDataFrame([(d,) for d in days], "period string")


_VOL = _DAYS_AB + """, v AS (SELECT period, cast(coalesce(sum(cnt) FILTER (WHERE app_version = '2.0'), 0) AS double) AS a_cnt, cast(coalesce(sum(cnt) FILTER (WHERE app_version = '1.0'), 0) AS double) AS b_cnt, sum(cnt) AS n
  FROM c_transition WHERE period IN (SELECT period FROM d) GROUP BY period)"""


def _volumes(spark, folder) -> DataFrame:
    t = Workspace(spark, folder).cubes().transition
    return measures.day_volumes(t, *_AB, measures.comparable_days(t, *_AB))


@query("day_volumes", O.over("transition", ctes=_VOL, select=f"SELECT period, a_cnt, b_cnt, {O.r('a_cnt / n')} AS a_share FROM v"))
def day_volumes(spark, folder):
    return rounded(_volumes(spark, folder))


@query("weight_skew", O.over("transition", ctes=_VOL, select=f"SELECT {O.r('sum(abs(a_cnt / (SELECT sum(a_cnt) FROM v) - b_cnt / (SELECT sum(b_cnt) FROM v))) / 2')} AS weight_skew FROM v"))
def weight_skew(spark, folder):
    return rounded(measures.weight_skew(_volumes(spark, folder)))


def _compared(name: str, **params) -> Callable[[SparkSession, str], segments.Comparison]:
    return lambda spark, folder: segments.compare(Workspace(spark, folder).cubes(), name, *_AB, **params)


def _as_frame(spark: SparkSession, pdf, schema: str) -> DataFrame:
    names = [p.strip().split()[0] for p in schema.split(",")]
    return rounded(spark.createDataFrame([tuple(None if isinstance(v, float) and v != v else v for v in row) for row in pdf[names].itertuples(index=False)], schema))


_SHARE = f"CASE WHEN {O.FROM_SERVICE} IS NOT NULL AND {O.TO_SERVICE} IS NOT NULL THEN cnt END"
_CROSSED = f"CASE WHEN {O.FROM_SERVICE} <> {O.TO_SERVICE} THEN cnt END"


def _cross_delta(where: str = "true") -> str:
    side = "(sum({1}) FILTER (WHERE app_version = '{0}' AND " + where + ") / sum({2}) FILTER (WHERE app_version = '{0}' AND " + where + "))"
    return f"{side.format('2.0', 'coalesce(' + _CROSSED + ', 0)', _SHARE)} / {side.format('1.0', 'coalesce(' + _CROSSED + ', 0)', _SHARE)} - 1"


@query("compare_cross_service", O.over("transition", ctes=_DAYS_AB, select=f"SELECT {O.r(_cross_delta())} AS delta_cross_service_share FROM c_transition WHERE period IN (SELECT period FROM d)"))
def compare_cross_service(spark, folder):
    c = _compared("cross_service_flow")(spark, folder)
    return rounded(spark.createDataFrame([(c.pooled["cross_service_share"],)], "delta_cross_service_share double"))


@query("compare_cross_service_days", O.over("transition", ctes=_DAYS_AB, select=f"SELECT period, {O.r(_cross_delta())} AS delta_cross_service_share FROM c_transition WHERE period IN (SELECT period FROM d) GROUP BY period"))
def compare_cross_service_days(spark, folder):
    return _as_frame(spark, _compared("cross_service_flow")(spark, folder).per_day, "period string, delta_cross_service_share double")


@query("compare_session_trend", O.over("session", "transition", ctes=_DAYS_AB + ", s AS (SELECT app_version, count(*) AS n, sum(pv) AS pv, sum(duration_sec) AS sec FROM kept WHERE period IN (SELECT period FROM d) GROUP BY 1)", select=f"""SELECT {O.r('a.n / b.n - 1')} AS delta_sessions, {O.r('(a.pv / a.n) / (b.pv / b.n) - 1')} AS delta_pv_per_session,
  {O.r('(a.sec / a.n) / (b.sec / b.n) - 1')} AS delta_seconds_per_session FROM s a, s b WHERE a.app_version = '2.0' AND b.app_version = '1.0'"""))
def compare_session_trend(spark, folder):
    p = _compared("session_trend")(spark, folder).pooled
    return rounded(spark.createDataFrame([(p["sessions"], p["pv_per_session"], p["seconds_per_session"])], "delta_sessions double, delta_pv_per_session double, delta_seconds_per_session double"))


# Visit-weighted steps and exits of many chains at once: one for each ``slice`` of w(slice, from_state, to_state, cnt).
_CHAINS = """pw AS (SELECT slice, from_state, to_state, cnt, cnt / sum(cnt) OVER (PARTITION BY slice, from_state) AS prob FROM w),
sw AS (SELECT DISTINCT slice, state FROM (SELECT slice, from_state AS state FROM w UNION ALL SELECT slice, to_state FROM w) WHERE state NOT IN ('START', 'EXIT')),
left_in(k, slice, origin, state, mass) AS (
  SELECT 0, slice, state, state, cast(1.0 AS double) FROM sw
  UNION ALL SELECT k + 1, l.slice, origin, q.to_state, sum(mass * q.prob) FROM left_in l JOIN pw q ON q.slice = l.slice AND q.from_state = l.state WHERE l.k < 300 AND q.to_state <> 'EXIT' GROUP BY k, l.slice, origin, q.to_state),
steps AS (SELECT slice, origin AS state, sum(mass) AS steps FROM left_in GROUP BY 1, 2),
heads AS (
  SELECT slice, sum(steps * visits) / sum(visits) AS mean_expected_steps, sum(exits) / sum(visits) AS mean_exit_prob
  FROM (SELECT slice, from_state AS state, sum(cnt) AS visits, coalesce(sum(cnt) FILTER (WHERE to_state = 'EXIT'), 0) AS exits FROM w WHERE from_state NOT IN ('START', 'EXIT') GROUP BY 1, 2) JOIN steps USING (slice, state) GROUP BY 1)"""
_BY_DAY = _DAYS_AB + ", w AS (SELECT period || app_version AS slice, from_state, to_state, sum(cnt) AS cnt FROM c_transition WHERE period IN (SELECT period FROM d) AND app_version IN ('1.0', '2.0') GROUP BY ALL), " + _CHAINS


@query("compare_screen_flow", O.over("transition", recursive=True, ctes=_BY_DAY, select=f"""SELECT period, {O.r('a.mean_expected_steps / b.mean_expected_steps - 1')} AS delta_mean_expected_steps, {O.r('a.mean_exit_prob / b.mean_exit_prob - 1')} AS delta_mean_exit_prob
  FROM d JOIN heads a ON a.slice = period || '2.0' JOIN heads b ON b.slice = period || '1.0'"""))
def compare_screen_flow(spark, folder):
    return _as_frame(spark, _compared("screen_flow")(spark, folder).per_day, "period string, delta_mean_expected_steps double, delta_mean_exit_prob double")


_STRATA = f""", z AS (SELECT os, cast(coalesce(sum(cnt) FILTER (WHERE app_version = '2.0'), 0) AS double) AS a_cnt, cast(coalesce(sum(cnt) FILTER (WHERE app_version = '1.0'), 0) AS double) AS b_cnt, {_cross_delta()} AS delta
  FROM c_transition WHERE period IN (SELECT period FROM d) GROUP BY os)"""


def _split(spark, folder) -> tuple[segments.Comparison, segments.Decomposition]:
    cubes = Workspace(spark, folder).cubes()
    c = segments.compare(cubes, "cross_service_flow", *_AB)
    return c, segments.decompose(cubes, c, ["os"], "cross_service_share")


@query("decompose_strata", O.over("transition", ctes=_DAYS_AB + _STRATA, select=f"SELECT os, a_cnt, b_cnt, {O.r('delta')} AS delta FROM z"))
def decompose_strata(spark, folder):
    return _as_frame(spark, _split(spark, folder)[1].per_stratum, "os string, a_cnt double, b_cnt double, delta double")


@query("decompose_parts", O.over("transition", ctes=_DAYS_AB + _STRATA, select=f"""SELECT {O.r('sum(delta * b_cnt) / sum(b_cnt)')} AS within, {O.r('(SELECT ' + _cross_delta() + ' FROM c_transition WHERE period IN (SELECT period FROM d)) - sum(delta * b_cnt) / sum(b_cnt)')} AS "between",
  {O.r('sum(abs(a_cnt / (SELECT sum(a_cnt) FROM z) - b_cnt / (SELECT sum(b_cnt) FROM z))) / 2')} AS composition_os FROM z"""))
def decompose_parts(spark, folder):
    _, d = _split(spark, folder)
    return rounded(spark.createDataFrame([(d.within, d.between, d.composition["os"])], "within double, between double, composition_os double"))


_WITHIN = f"""w AS (SELECT v.service, from_state, to_state, sum(cnt) AS cnt FROM c_transition, (SELECT DISTINCT {O.FROM_SERVICE} AS service FROM c_transition WHERE {_ON}) v
  WHERE (from_state IN ('START', 'EXIT') OR {O.FROM_SERVICE} = v.service) AND (to_state IN ('START', 'EXIT') OR {O.TO_SERVICE} = v.service) GROUP BY 1, 2, 3),
n AS (SELECT service, sum(cnt) AS cnt FROM (SELECT {O.FROM_SERVICE} AS service, cnt FROM c_transition) WHERE service IS NOT NULL GROUP BY 1)"""


@query("per_service_transition", O.over("transition", ctes=_WITHIN, select=f"""SELECT service, cast(n.cnt AS double) AS cnt, {O.r('n.cnt / (SELECT sum(cnt) FROM n)')} AS share, (SELECT cast(count(*) AS double) FROM w WHERE w.service = n.service) AS pairs,
  (SELECT cast(count(DISTINCT s) AS double) FROM (SELECT from_state AS s, w.service FROM w UNION ALL SELECT to_state, w.service FROM w) u WHERE u.service = n.service) AS states FROM n"""))
def per_service_transition(spark, folder):
    return _as_frame(spark, segments.per_service(Workspace(spark, folder).cubes(), "screen_transition").frame, "service string, cnt double, share double, pairs double, states double")


_BY_SERVICE = _WITHIN.replace("w AS (SELECT v.service, from_state", "w AS (SELECT v.service AS slice, from_state") + ", " + _CHAINS + ", " + _SVC + ", os AS (SELECT service, coalesce(sum(cnt) FILTER (WHERE from_state LIKE '%/other'), 0) / sum(cnt) AS other_share FROM s WHERE service IS NOT NULL GROUP BY 1)"


@query("per_service_flow", O.over("transition", recursive=True, ctes=_BY_SERVICE, select=f"""SELECT n.service, cast(n.cnt AS double) AS cnt, {O.r('n.cnt / (SELECT sum(cnt) FROM n)')} AS share, {O.r('other_share')} AS other_share,
  {O.r('mean_expected_steps')} AS mean_expected_steps, {O.r('mean_exit_prob')} AS mean_exit_prob FROM n JOIN heads ON heads.slice = n.service JOIN os ON os.service = n.service"""))
def per_service_flow(spark, folder):
    return _as_frame(spark, segments.per_service(Workspace(spark, folder).cubes(), "screen_flow").frame, "service string, cnt double, share double, other_share double, mean_expected_steps double, mean_exit_prob double")


@query("crossing_share", O.over("transition", select=f"SELECT {O.r('sum(coalesce(' + _CROSSED + ', 0)) / sum(' + _SHARE + ')')} AS cross_service_share FROM c_transition"))
def crossing_share(spark, folder):
    return rounded(segments.crossing_share(Workspace(spark, folder).cubes().transition))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Chance of the next screen, given the current one, over all days."""
    return QUERIES["screen_transition"](spark, folder)


__all__ = ["ORACLE", "QUERIES", "Workspace", "flagship"]
