"""The six daily cubes, for any number of days at once.

Five come from one marked event table (``sessions.marked``); quality looks at
all events, valid or not.  Every cube has ``date``, the day whose build a row
belongs to; in the session cube ``period`` is null where it is rolled up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import columns as C
from pathloom.plans import sessions as S
from pathloom.plans.vocabulary import StateDict

#: Cubes of what visits follow each other.
OF_VISITS = ("transition", "cond_transition", "path")
CUBES = ("session", "transition", "action", "cond_transition", "path", "quality")
PATH_LENGTHS, PATH_TOP = (3, 4, 5), 200
TIMEOUT_SECONDS = 21_600
CHECKS = (
    "null_action_name", "pageview_null_kind", "screen_other_ratio", "session_no_screen", "page_name_ambiguous", "session_span_exceeds_timeout",
    "screen_without_dwell", "exit_without_appexit",
)

SCHEMAS = {
    "session": "period string, service_type string, os string, gender string, age_band string, daypart string, app_version string, sessions long, uv long, pv long, events long, duration_sum long, date string",
    "transition": "period string, service_type string, os string, gender string, age_band string, daypart string, app_version string, from_state string, to_state string, cnt long, dur_sum double, dur_n long, date string",
    "action": "period string, service_type string, os string, gender string, age_band string, daypart string, app_version string, screen string, action_kind string, layer1 string, layer2 string, cnt long, date string",
    "cond_transition": "period string, service_type string, os string, app_version string, from_state string, action_kind string, to_state string, cnt long, date string",
    "path": "period string, service_type string, os string, gender string, age_band string, daypart string, app_version string, n int, path string, cnt long, distinct_dropped long, date string",
    "quality": "service_code string, app_version string, period string, check_name string, violated long, total long, date string",
}


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.col("period"))


def session_cube(rows: DataFrame) -> DataFrame:
    """All axes; each axis but period folded; period alone; nothing: users do not add up, so roll-ups are made here."""
    one = S.session_rows(rows).withColumn("date", F.col("period"))
    axes = [F.col(a) for a in C.AXES]
    folded = [[a for b, a in zip(C.AXES, axes, strict=True) if b != drop] for drop in C.AXES[1:]]
    date = F.col("date")
    sets = [[*axes], *folded, [F.col("period")], []]
    out = one.groupingSets([[date, *s] for s in sets], date, *axes).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_distinct("uuid").alias("uv"), F.sum("pv").alias("pv"), F.sum("events").alias("events"), F.sum("duration_sec").alias("duration_sum")
    )
    return out.select(*C.AXES, "sessions", "uv", "pv", "events", "duration_sum", "date")


def transition_cube(visits: DataFrame) -> DataFrame:
    edges = S.edge_rows(visits)
    out = edges.groupBy(*C.AXES, "from_state", "to_state").agg(
        F.count(F.lit(1)).alias("cnt"), F.coalesce(F.sum("dwell"), F.lit(0.0)).alias("dur_sum"), F.count("dwell").alias("dur_n")
    )
    return _dated(out)


def action_cube(rows: DataFrame) -> DataFrame:
    """Clicks by the screen before them; those before the first screen are START's."""
    clicks = rows.where("is_click").select(*C.AXES, F.coalesce("at_state", F.lit(C.START)).alias("screen"), F.col("kind").alias("action_kind"), F.col("slot1").alias("layer1"), F.col("slot2").alias("layer2"))
    return _dated(clicks.groupBy(*C.AXES, "screen", "action_kind", "layer1", "layer2").agg(F.count(F.lit(1)).alias("cnt")))


def cond_transition_cube(rows: DataFrame, visits: DataFrame) -> DataFrame:
    """Pairs of a click and the edge it led to; an edge without a click is one pair with ``(no_click)``."""
    edges = S.edge_rows(visits)
    clicks = rows.where("is_click").groupBy(*S.SESSION, "visit_idx", F.col("kind").alias("action_kind")).agg(F.count(F.lit(1)).alias("clicks"))
    pairs = edges.join(clicks, [*S.SESSION, "visit_idx"], "left").select(
        *C.COND_AXES, "from_state", F.coalesce("action_kind", F.lit(C.NO_CLICK)).alias("action_kind"), "to_state", F.coalesce("clicks", F.lit(1)).alias("n")
    )
    return _dated(pairs.groupBy(*C.COND_AXES, "from_state", "action_kind", "to_state").agg(F.sum("n").alias("cnt")))


def ngram_rows(visits: DataFrame) -> DataFrame:
    """n and path of every run of three, four and five visits."""
    step = [F.col("state"), *[F.col(f"next{k}") for k in range(1, 5)]]

    def gram(n: int) -> Column:
        # || gives null where the session is too short.
        out = step[0]
        for s in step[1:n]:
            out = F.concat(out, F.lit(">"), s)
        return F.struct(F.lit(n).alias("n"), out.alias("path"))

    grams = F.filter(F.array(*[gram(n) for n in PATH_LENGTHS]), lambda g: g["path"].isNotNull())
    return visits.select(*C.AXES, F.explode(grams).alias("g")).select(*C.AXES, "g.n", "g.path")


def top_with_rest(counted: DataFrame, keys: Sequence[str], item: str, top: int) -> DataFrame:
    """The ``top`` items of each group and one row for the rest: the total stays, and the row says how many it stands for."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cnt"), item))
    ranked = counted.withColumn("_kept", rank <= top)
    folded = ranked.groupBy(*keys, F.when(F.col("_kept"), F.col(item)).otherwise(C.TAIL).alias(item))
    return folded.agg(F.sum("cnt").alias("cnt"), F.sum((~F.col("_kept")).cast("long")).alias("distinct_dropped"))


def path_cube(visits: DataFrame, top: int = PATH_TOP) -> DataFrame:
    counted = ngram_rows(visits).groupBy(*C.AXES, "n", "path").agg(F.count(F.lit(1)).alias("cnt"))
    return _dated(top_with_rest(counted, [*C.AXES, "n"], "path", top))


def quality_cube(events: DataFrame, days: Sequence[str]) -> DataFrame:
    """Violations and totals of eight checks by service and version; ratios are for the reader to make.

    Checks of rows and visits look at the day's own partition, checks of sessions
    at the three partitions of its build.  Invalid events count, as they are what
    is checked.
    """
    all_rows = S.by_user(events).select(
        "event_id", "uuid", "suid", "ts", "date_id", "service_code", F.coalesce("raw_version", F.lit(C.UNKNOWN)).alias("app_version"), "action_type", "action_kind",
        C.filled(F.col("action_name")).alias("name"), C.filled(F.col("page")).alias("page"),
    ).withColumns({"is_screen": F.coalesce((F.col("action_type") == "Pageview").cast("int"), F.lit(0))})
    group = ["service_code", "app_version", "period"]
    day = all_rows.where(F.col("date_id").isin(*days)).withColumn("period", F.col("date_id"))
    screen = F.col("is_screen") == 1

    by_row = day.groupBy(*group).agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("name").isNull()).alias("null_action_name"), F.count_if(screen & F.col("action_kind").isNull()).alias("pageview_null_kind"),
        F.count_if(screen).alias("screens"), F.count_if(screen & F.col("name").isNull()).alias("screen_other_ratio"),
    )
    names = day.where(screen & F.col("name").isNotNull()).groupBy(*group, "name").agg(F.count_distinct("page").alias("pages"))
    by_name = names.groupBy(*group).agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("pages") > 1).alias("page_name_ambiguous"))

    order = Window.partitionBy("uuid", "suid", "period").orderBy(F.asc_nulls_last("ts"), F.desc("is_screen"), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stream = day.where(screen | ((F.col("action_type") == "Usage") & (F.col("action_kind") == "UsagePage"))).withColumn("visit_idx", F.sum("is_screen").over(order))
    # The row's own service and version are part of the key: dwell under another service makes a second group.
    visits = stream.where("visit_idx > 0").groupBy("uuid", "suid", "visit_idx", *group).agg(F.max(F.col("action_type") == "Usage").alias("has_dwell"))
    by_visit = visits.groupBy(*group).agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("has_dwell")).alias("screen_without_dwell"))

    timed = S.attributed(all_rows, days)
    at_exit = (F.col("action_type") == "App") & (F.col("action_kind") == "AppExit")
    sess = timed.groupBy(*S.SESSION, "period").agg(
        F.min_by(F.struct("service_code", "app_version"), F.struct("ts", "event_id")).alias("first"), F.sum("is_screen").alias("pv"),
        F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("span"), F.max(F.when(screen, F.col("ts"))).alias("last_pv"), F.max(F.when(at_exit, F.col("ts"))).alias("last_exit"),
        F.count_if(F.col("action_type") == "App").alias("app_events"),
    ).select("first.*", "period", "pv", "span", "last_pv", "last_exit", "app_events")
    in_app = F.col("last_pv").isNotNull() & (F.col("app_events") > 0)
    by_session = sess.groupBy(*group).agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("pv") == 0).alias("session_no_screen"), F.count_if(F.col("span") > TIMEOUT_SECONDS).alias("session_span_exceeds_timeout"),
        F.count_if(in_app).alias("app_sessions"), F.count_if(in_app & (F.col("last_exit").isNull() | (F.col("last_exit") < F.col("last_pv")))).alias("exit_without_appexit"),
    )

    def checks(df: DataFrame, **totals: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).cast("long").alias("violated"), F.col(t).cast("long").alias("total")) for k, t in totals.items()])
        return df.select(*group, F.explode(rows).alias("c")).select(*group, "c.*").where("total > 0")

    out = (
        checks(by_row, null_action_name="all", pageview_null_kind="all", screen_other_ratio="screens")
        .unionByName(checks(by_name, page_name_ambiguous="all")).unionByName(checks(by_visit, screen_without_dwell="all"))
        .unionByName(checks(by_session, session_no_screen="all", session_span_exceeds_timeout="all", exit_without_appexit="app_sessions"))
    )
    return _dated(out.select("service_code", "app_version", "period", "check_name", "violated", "total"))


def build(name: str, events: DataFrame, days: Sequence[str], vocabulary: StateDict, rows: DataFrame | None = None, top: int = PATH_TOP, visits: DataFrame | None = None) -> DataFrame:
    """One cube; ``rows`` and ``visits``, if given, are ``marked`` of the same events and their ``visit_rows``."""
    if name == "quality":
        return quality_cube(events, days)
    rows = S.marked(events, days, vocabulary) if rows is None else rows
    if name in ("session", "action"):
        return {"session": session_cube, "action": action_cube}[name](rows)
    visits = S.visit_rows(rows) if visits is None else visits
    if name == "path":
        return path_cube(visits, top)
    return {"transition": lambda: transition_cube(visits), "cond_transition": lambda: cond_transition_cube(rows, visits)}[name]()
