"""Measures over cubes: coverage, services, clicks, dwell, paths, days.

Each gives one row for each combination of ``keys`` (and of its own grouping).
A ratio without a positive denominator is null.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import columns as C
from pathloom.operators import frames
from pathloom.plans.cubes import PATH_LENGTHS

Keys = Sequence[str]
DWELL_DEFINITION = "last event minus first event of a session, in seconds"
TAIL_DOMINATES = 0.5


class ConfoundedComparisonError(ValueError):
    """Two segments share no comparable day, so a difference would measure the calendar."""


class UnverifiedWindowError(ValueError):
    """Days outside the windows in which holidays are known."""


def _ends(state: str):
    return F.col(state).isin(*C.ENDS)


# ---------------------------------------------------------------- services


def service_mix(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """service, cnt, share of the steps that leave a screen."""
    own = edges.withColumn("service", C.service_of(F.col("from_state"))).where("service is not null").groupBy(*keys, "service").agg(F.sum("cnt").alias("cnt"))
    return own.withColumn("share", C.ratio(F.col("cnt"), F.sum("cnt").over(Window.partitionBy(*(keys or [F.lit(1)])))))


def other_share(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """For each service the share of its screens' steps that leave the bucket of unlisted screens."""
    own = edges.withColumn("service", C.service_of(F.col("from_state"))).where("service is not null")
    lumped = F.sum(F.when(C.is_lumped(F.col("from_state")), F.col("cnt")).otherwise(0))
    return own.groupBy(*keys, "service").agg(F.coalesce(C.ratio(lumped, F.sum("cnt")), F.lit(0.0)).alias("other_share"))


# ---------------------------------------------------------------- coverage


def demography_coverage(session: DataFrame, keys: Keys = ()) -> DataFrame:
    full = frames.full_rows(session)
    known = lambda a: F.sum(F.when(F.col(a) != C.UNKNOWN, F.col("sessions")).otherwise(0))
    return full.groupBy(*keys).agg(C.ratio(known("gender"), F.sum("sessions")).alias("gender"), C.ratio(known("age_band"), F.sum("sessions")).alias("age_band"))


def dwell_coverage(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    on = edges.where(~_ends("from_state"))
    return on.groupBy(*keys).agg(C.ratio(F.sum("dur_n"), F.sum("cnt")).alias("dwell_coverage"))


def screen_coverage(quality: DataFrame, keys: Keys = ()) -> DataFrame:
    """Share of sessions with a screen."""
    rows = quality.where(F.col("check_name") == "session_no_screen")
    return rows.groupBy(*keys).agg((1 - C.ratio(F.sum("violated"), F.sum("total"))).alias("screen_coverage"))


# ---------------------------------------------------------------- sessions


def uv_pv(session: DataFrame, folded: Iterable[str]) -> DataFrame:
    """Users, sessions, screens and events from the roll-up made with the cube; they are never summed up here."""
    folded = list(folded)
    out = frames.rollup_rows(session, folded)
    kept = [a for a in C.AXES if a not in folded]
    return out.select(*kept, "uv", "pv", "sessions", "events", "duration_sum")


def engagement(session: DataFrame, folded: Iterable[str]) -> DataFrame:
    folded = list(folded)
    kept = [a for a in C.AXES if a not in folded]
    return uv_pv(session, folded).select(
        *kept, C.ratio(F.col("sessions"), F.col("uv")).alias("sessions_per_user"), C.ratio(F.col("pv"), F.col("sessions")).alias("pv_per_session"),
        C.ratio(F.col("duration_sum"), F.col("sessions")).alias("seconds_per_session"), F.lit(DWELL_DEFINITION).alias("dwell_definition"),
    )


# ---------------------------------------------------------------- screens and clicks


def screen_dwell(edges: DataFrame, keys: Keys = ()) -> DataFrame:
    """Seconds a measured visit of each screen; never over all visits, which coverage would shrink."""
    on = edges.where(~_ends("from_state")).groupBy(*keys, F.col("from_state").alias("state")).agg(
        F.sum("cnt").alias("visits"), F.sum("dur_n").alias("measured_visits"), F.sum("dur_sum").alias("seconds")
    )
    return on.withColumns({"seconds_per_visit": C.ratio(F.col("seconds"), F.col("measured_visits")), "coverage": C.ratio(F.col("measured_visits"), F.col("visits"))})


def click_share(action: DataFrame, by: Sequence[str] = ("action_kind",), keys: Keys = ()) -> DataFrame:
    """Clicks by screen and ``by`` with their share within the screen."""
    own = action.groupBy(*keys, "screen", *by).agg(F.sum("cnt").alias("cnt"))
    return own.withColumn("share", C.ratio(F.col("cnt"), F.sum("cnt").over(Window.partitionBy(*keys, "screen"))))


def clicks_per_visit(action: DataFrame, edges: DataFrame, keys: Keys = ()) -> DataFrame:
    clicks = action.where(~_ends("screen")).groupBy(*keys, "screen").agg(F.sum("cnt").alias("clicks"))
    visits = edges.where(~_ends("from_state")).groupBy(*keys, F.col("from_state").alias("screen")).agg(F.sum("cnt").alias("visits"))
    return clicks.join(visits, [*keys, "screen"], "left").withColumn("clicks_per_visit", C.ratio(F.col("clicks"), F.col("visits")))


# ---------------------------------------------------------------- paths


def _of_length(path: DataFrame, n: int | None) -> DataFrame:
    if n is None:
        raise ValueError("paths of different lengths are different populations: give n")
    if n not in PATH_LENGTHS:
        raise KeyError(f"no paths of length {n}; there are {PATH_LENGTHS}")
    return path.where(F.col("n") == n)


def path_coverage(path: DataFrame, n: int | None, keys: Keys = ()) -> DataFrame:
    """coverage: share of windows that the kept paths stand for; distinct_dropped: how many paths the rest row hides."""
    rest = F.sum(F.when(F.col("path") == C.TAIL, F.col("cnt")).otherwise(0))
    return _of_length(path, n).groupBy(*keys).agg((1 - C.ratio(rest, F.sum("cnt"))).alias("coverage"), F.sum("distinct_dropped").alias("distinct_dropped"))


def top_paths(path: DataFrame, n: int | None, keys: Keys = ()) -> DataFrame:
    """Paths with cnt and share; the rest row is in the denominator, not in the ranking."""
    own = _of_length(path, n).groupBy(*keys, "path").agg(F.sum("cnt").alias("cnt"))
    out = own.withColumn("share", C.ratio(F.col("cnt"), F.sum("cnt").over(Window.partitionBy(*(keys or [F.lit(1)])))))
    return out.where(F.col("path") != C.TAIL)


# ---------------------------------------------------------------- communities


def modularity(edges: DataFrame, of: DataFrame, keys: Keys = (), resolution: float = 1.0) -> DataFrame:
    """modularity of a given split of the screens: ``of`` has keys, state and community.

    Directions are added up and a loop counts at both of its ends.  Steps at an
    end of the session, or at a screen without a community, are left out.
    """
    side = lambda s: of.select(*keys, F.col("state").alias(f"{s}_state"), F.col("community").alias(f"{s}_of"))
    both = edges.where("cnt > 0").groupBy(*keys, "from_state", "to_state").agg(F.sum("cnt").alias("cnt")).join(side("from"), [*keys, "from_state"]).join(side("to"), [*keys, "to_state"])
    within = F.when(F.col("from_of") == F.col("to_of"), F.col("cnt")).otherwise(0)
    ends = F.array(F.struct(F.col("from_of").alias("community"), within.alias("inside")), F.struct(F.col("to_of").alias("community"), F.lit(0).cast("long").alias("inside")))
    each = both.select(*keys, "cnt", F.explode(ends).alias("e")).groupBy(*keys, "e.community").agg(F.sum("e.inside").alias("inside"), F.sum("cnt").cast("double").alias("around"))
    whole = F.sum("around")
    return each.groupBy(*keys).agg((2 * F.sum("inside") / whole - resolution * F.sum(F.col("around") * F.col("around")) / (whole * whole)).alias("modularity"))


def paths_within(path: DataFrame, of: DataFrame, n: int = 5, keys: Keys = ()) -> DataFrame:
    """Paths of ``n`` steps all of whose screens are of one community, with their share and rank among its paths."""
    paths = top_paths(path, n, keys).where(F.size(F.split("path", ">")) == n)
    steps = paths.select(*keys, "path", "cnt", F.explode(F.split("path", ">")).alias("state")).join(of.select(*keys, "state", "community"), [*keys, "state"], "left")
    inside = steps.groupBy(*keys, "path", "cnt").agg(F.count_distinct("community").alias("n"), F.count("community").alias("known"), F.max("community").alias("community")).where(f"n = 1 and known = {n}")
    per = Window.partitionBy(*keys, "community")
    shared = inside.withColumns({"support_in_comm": F.col("cnt") / F.sum("cnt").over(per), "rank": F.row_number().over(per.orderBy(F.desc("cnt"), "path"))})
    return shared.select(*keys, "community", "rank", "path", "cnt", "support_in_comm")


# ---------------------------------------------------------------- days


def split_by_kind(days: Iterable[str], holidays: Iterable[str], verified: Sequence[tuple[str, str]] | None = None) -> dict[str, list[str]]:
    """Days by weekday, weekend, holiday; each in one list."""
    from datetime import date

    days, holidays = sorted(days), set(holidays)
    if verified:
        outside = [d for d in days if not any(a <= d <= b for a, b in verified)]
        if outside:
            raise UnverifiedWindowError(f"holidays are not known on {', '.join(outside[:5])}")
    out: dict[str, list[str]] = {"weekday": [], "weekend": [], "holiday": []}
    for d in days:
        out["holiday" if d in holidays else "weekend" if date.fromisoformat(d).weekday() >= 5 else "weekday"].append(d)
    return out


def comparable_days(cube: DataFrame, on: str, a: str, b: str, released: Mapping[str, str] | None = None) -> list[str]:
    """Days on which both values occur, not before the later of their releases."""
    if on not in cube.columns:
        raise KeyError(f"no such column: {on!r}")
    rows = cube.where(F.col(on).isin(a, b) & F.col("period").isNotNull()).select(on, "period").distinct().collect()
    days = {v: {r["period"] for r in rows if r[on] == v} for v in (a, b)}
    cutoff = max((released[v] for v in (a, b) if released and released.get(v)), default="")
    for v in (a, b):
        if not days[v]:
            raise ConfoundedComparisonError(f"{on}={v!r} does not occur in this cube")
        if not {d for d in days[v] if d >= cutoff}:
            raise ConfoundedComparisonError(f"all days of {on}={v!r} are before the release on {cutoff}")
    both = sorted(d for d in days[a] & days[b] if d >= cutoff)
    if not both:
        raise ConfoundedComparisonError(f"{on}={a!r} and {on}={b!r} share no day")
    return both


def day_volumes(cube: DataFrame, on: str, a: str, b: str, days: Sequence[str], measure: str = "cnt") -> DataFrame:
    """Volume of both values on each day, and a's share of all values."""
    m = F.col(measure).cast("double")
    rows = cube.where(F.col("period").isin(*days)).groupBy("period").agg(
        F.sum(F.when(F.col(on) == a, m).otherwise(0.0)).alias("a_cnt"), F.sum(F.when(F.col(on) == b, m).otherwise(0.0)).alias("b_cnt"), F.sum(m).alias("_all")
    )
    return rows.withColumn("a_share", C.ratio(F.col("a_cnt"), F.col("_all"))).drop("_all")


def weight_skew(volumes: DataFrame) -> DataFrame:
    """Half the summed differences of the two values' day weights: 0 if they lie alike."""
    whole = Window.partitionBy(F.lit(1))
    d = F.abs(C.ratio(F.col("a_cnt"), F.sum("a_cnt").over(whole)) - C.ratio(F.col("b_cnt"), F.sum("b_cnt").over(whole)))
    return volumes.withColumn("d", d).agg((F.sum("d") / 2).alias("weight_skew"))


# ---------------------------------------------------------------- quality


def quality_ratios(quality: DataFrame, by: Sequence[str] = ("check_name", "period"), keys: Keys = ()) -> DataFrame:
    """Counts are summed first, then divided."""
    own = quality.groupBy(*keys, *by).agg(F.sum("violated").alias("violated"), F.sum("total").alias("total"))
    return own.withColumn("ratio", C.ratio(F.col("violated"), F.col("total")))


def quality_warnings(quality: DataFrame, limits: Mapping[str, float], keys: Keys = ()) -> DataFrame:
    """Checks over their limit by service and day, versions folded; a check without a limit gives none."""
    by = [c for c in ("check_name", "service_code", "period") if c in quality.columns]
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("check_name")] if limits else F.lit(None).cast("double")
    return quality_ratios(quality, by, keys).withColumn("limit", limit).where("ratio > limit")
