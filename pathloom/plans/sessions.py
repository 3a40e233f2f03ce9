"""Sessions and visits in one pass over the events.

A session (uuid, suid) belongs to the day of its first event; its axes are those
of that event.  A build of day D sees the partitions D-1, D and D+1 only, so an
event takes part in the builds of the days around its partition.  All days are
built at once: an event goes to those candidate days on which its session has an
event, and a window over (uuid, suid, build day) decides.

All windows below are partitioned by keys that begin with uuid, so events that
are hashed by uuid once are never shuffled again before the cubes' aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import columns as C
from pathloom.plans.vocabulary import StateDict

SESSION = ("uuid", "suid", "build_day")
FROZEN = C.AXES[1:]


def by_user(events: DataFrame) -> DataFrame:
    """The one shuffle: every later window and join stays within a user's partition."""
    return events.repartition("uuid")


def fan_out(events: DataFrame, days: Sequence[str]) -> DataFrame:
    """Each event once for every build day in ``days`` that sees it (column build_day, a date)."""
    session = Window.partitionBy("uuid", "suid")
    near = F.expr("filter(days, d -> abs(datediff(d, to_date(date_id))) <= 1)")
    out = events.withColumn("days", F.collect_set(F.to_date("ts")).over(session)).withColumn("build_day", F.explode(near)).drop("days")
    return out.where(_among(days))


def _among(days: Sequence[str]):
    """Whether build_day is one of ``days``, however many; gaps between them are left out."""
    return F.col("build_day").isin(*[F.lit(d).cast("date") for d in sorted(set(days))])


def attributed(events: DataFrame, days: Sequence[str], whole_sessions: bool = False) -> DataFrame:
    """Events of the sessions that start on their build day, with ``period``.

    ``whole_sessions`` counts each session once, with all its events, on the day
    of its first event, however long it is; by default a build sees three
    partitions, so longer sessions are cut and one with a day's hole counts
    twice.
    """
    if whole_sessions:
        first = F.to_date(F.min("ts").over(Window.partitionBy("uuid", "suid")))
        out = events.withColumn("build_day", first).where(_among(days))
    else:
        out = fan_out(events, days).withColumn("t0", F.min("ts").over(Window.partitionBy(*SESSION))).where("to_date(t0) = build_day").drop("t0")
    return out.withColumn("period", F.date_format("build_day", "yyyy-MM-dd"))


def frozen(events: DataFrame, versions: Sequence[str]) -> DataFrame:
    """Axes replaced by those of the session's first event (ties: the least event_id)."""
    folded = events.withColumn("app_version", C.listed(F.col("raw_version"), versions))
    first = F.min_by(F.struct(*FROZEN), F.struct("ts", "event_id")).over(Window.partitionBy(*SESSION))
    return folded.withColumn("_first", first).withColumns({a: F.col(f"_first.{a}") for a in FROZEN}).drop("_first")


def marked(events: DataFrame, days: Sequence[str], vocabulary: StateDict, whole_sessions: bool = False) -> DataFrame:
    """Attributed events with their kind, state and visit number.

    ``visit_idx`` is the number of screens up to the row: a backward as-of join
    written as a running sum.  At equal times a screen comes before the rows that
    belong to it; rows, not a range of time, count, so two screens at one time
    are two visits.
    """
    is_screen = F.col("action_type") == "Pageview"
    rows = frozen(attributed(by_user(events.where("is_valid")), days, whole_sessions), vocabulary.app_versions)
    l1 = F.trim("layer1")
    rows = rows.withColumns({
        "is_screen": F.coalesce(is_screen, F.lit(False)).cast("int"),
        "is_dwell": F.coalesce((F.col("action_type") == "Usage") & (F.col("action_kind") == "UsagePage"), F.lit(False)),
        "is_click": F.coalesce(~is_screen, F.lit(True)) & C.filled(F.col("layer1")).isNotNull(),
        "state": F.when(is_screen, C.screen_state(F.col("service_code"), F.col("action_name"), vocabulary.screens)),
        "kind": C.or_else(F.col("action_kind"), C.UNNAMED),
        "slot1": C.listed(l1, vocabulary.layer1), "slot2": C.listed(C.slot(F.col("layer1"), F.col("layer2")), vocabulary.layer2),
    })
    order = Window.partitionBy(*SESSION).orderBy("ts", F.desc("is_screen"), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({"visit_idx": F.sum("is_screen").over(order), "at_state": F.last("state", ignorenulls=True).over(order)})


def session_rows(rows: DataFrame) -> DataFrame:
    """One row for each session: axes, events, screens, seconds."""
    return rows.groupBy(*SESSION, *C.AXES).agg(
        F.count(F.lit(1)).alias("events"), F.sum("is_screen").alias("pv"), F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("duration_sec")
    )


def visit_rows(rows: DataFrame) -> DataFrame:
    """One row for each visit: its state, measured seconds (null if none), the next four states."""
    visits = (
        rows.where("(is_screen = 1 or is_dwell) and visit_idx > 0").groupBy(*SESSION, *C.AXES, "visit_idx")
        .agg(F.max("state").alias("state"), F.sum(F.when(F.col("is_dwell"), F.col("usage_duration_ms") / 1000)).alias("dwell"))
    )
    order = Window.partitionBy(*SESSION).orderBy("visit_idx")
    return visits.withColumns({f"next{k}": F.lead("state", k).over(order) for k in range(1, 5)})


def edge_rows(visits: DataFrame) -> DataFrame:
    """Edges of each session: visit to next visit or EXIT, and START to the first (without dwell)."""
    own = F.struct(F.col("visit_idx").alias("visit_idx"), F.col("state").alias("from_state"), F.coalesce("next1", F.lit(C.EXIT)).alias("to_state"), F.col("dwell").alias("dwell"))
    first = F.struct(F.lit(0).cast("long").alias("visit_idx"), F.lit(C.START).alias("from_state"), F.col("state").alias("to_state"), F.lit(None).cast("double").alias("dwell"))
    both = F.explode(F.when(F.col("visit_idx") == 1, F.array(own, first)).otherwise(F.array(own))).alias("e")
    return visits.select(*SESSION, *C.AXES, both).select(*SESSION, *C.AXES, "e.*")
