"""The sixteen analyses."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.analyses.base import CubeSet, Plan, analysis
from pathloom.functions import columns as C
from pathloom.operators import louvain, markov, measures

Keys = Sequence[str]
UNATTRIBUTED_WARN_ABOVE = 0.10
CONTEXT_DIVERGES = 0.1
EXIT_CHECK = "exit_without_appexit"


def whole(keys: Keys) -> Window:
    return Window.partitionBy(*(keys or [F.lit(1)]))


def _num(c):
    return c.cast("double")


def _joined(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Rows of the same slice side by side (single rows if there are no keys)."""
    return left.join(right, list(keys), "left") if keys else left.crossJoin(right)


def _thin_cells(edges: DataFrame) -> DataFrame:
    """Edge cells that were seen once: their probabilities are worth little."""
    used = edges.where("cnt > 0").agg(F.count_if(F.col("cnt") == 1).alias("single_observation_edges"), F.count(F.lit(1)).alias("n"), F.median("cnt").alias("median_cnt"))
    return used.where("single_observation_edges > 0").select(
        F.lit("thin_transition_cells").alias("check_name"), "single_observation_edges", (F.col("single_observation_edges") / F.col("n")).alias("share"), "median_cnt"
    )


def _dwell(edges: DataFrame) -> DataFrame:
    return measures.dwell_coverage(edges).withColumnRenamed("dwell_coverage", "dwell")


@analysis("session_trend")
def session_trend(cubes: CubeSet, keys: Keys = (), holidays: Sequence[str] | None = None) -> Plan:
    """Sessions, screens, users and time of each day.

    Users come from the roll-up row of the day; a segment has none, so its users
    are unknown while the additive measures are summed.  The headline is over the
    whole period, not a mean of days.
    """
    cubes.need("session_trend", "session")
    others = [F.col(a) for a in C.AXES[1:]]
    rolled, full = F.lit(True), F.lit(True)
    for a in others:
        rolled, full = rolled & a.isNull(), full & a.isNotNull()
    rows = cubes.session.where("period is not null")

    def either(m: str):
        return F.coalesce(F.max(F.when(rolled, F.col(m))), F.sum(F.when(full, F.col(m))))

    own = rows.groupBy(*keys, "period").agg(
        *[either(m).alias(m) for m in ("sessions", "pv", "events", "duration_sum")], F.max(F.when(rolled, F.col("uv"))).alias("uv"), F.max(rolled.cast("int")).alias("_rolled")
    )
    frame = own.withColumns({
        "sessions_per_user": C.ratio(F.col("sessions"), F.col("uv")), "pv_per_session": C.ratio(F.col("pv"), F.col("sessions")),
        "seconds_per_session": C.ratio(F.col("duration_sum"), F.col("sessions")), "dwell_definition": F.lit(measures.DWELL_DEFINITION),
    })
    if holidays is not None:
        frame = frame.withColumn("day_kind", C.day_kind(F.col("period"), holidays))
    headline = own.groupBy(*keys).agg(
        _num(F.sum("sessions")).alias("sessions"), C.ratio(F.sum("pv"), F.sum("sessions")).alias("pv_per_session"), C.ratio(F.sum("duration_sum"), F.sum("sessions")).alias("seconds_per_session")
    )
    cut = own.where("_rolled = 0").limit(1).select(F.lit("uv_unavailable_for_this_slice").alias("check_name"), F.lit("this segment has no roll-up row, and users do not add up").alias("reason"))
    return Plan(frame.drop("_rolled"), headline, measures.demography_coverage(cubes.session), (cut,), "period", {"kind": "line", "x": "period"}, (*keys, "period"))


@analysis("screen_dwell_rank")
def screen_dwell_rank(cubes: CubeSet, keys: Keys = (), warn_below: float = 0.5) -> Plan:
    """Seconds a measured visit of each screen; the headline weighs screens by measured visits."""
    cubes.need("screen_dwell_rank", "transition")
    frame = measures.screen_dwell(cubes.transition, keys)
    headline = frame.groupBy(*keys).agg(
        C.ratio(F.sum(F.when(F.col("measured_visits") > 0, F.col("seconds"))), F.sum("measured_visits")).alias("mean_seconds_per_visit"),
        C.ratio(F.sum("measured_visits"), F.sum("visits")).alias("dwell_coverage"),
    )
    low = measures.dwell_coverage(cubes.transition).where(F.col("dwell_coverage") < warn_below).select(F.lit("low_dwell_coverage").alias("check_name"), F.col("dwell_coverage").alias("coverage"), F.lit(float(warn_below)).alias("threshold"))
    return Plan(frame, headline, _dwell(cubes.transition), (low,), "state", {"kind": "bar", "x": "state"}, (*keys, "-seconds_per_visit", "state"))


@analysis("screen_flow")
def screen_flow(cubes: CubeSet, keys: Keys = (), exit_within: Sequence[int] = (), damping: float = 0.85) -> Plan:
    """Exit chance, stationary share, steps to exit, foreseeability and page rank of each screen.

    The headline weighs screens by visits, so it is about a screen view taken at
    random and means the same in every segment.  Steps are infinite where a
    session may get somewhere without a way out.
    """
    cubes.need("screen_flow", "transition")
    solved = markov.flow(cubes.transition, keys, damping, exit_within)
    horizons = [f"p_exit_within_{k}" for k in exit_within]
    rows = solved.where("error is null").drop("error")
    visits = F.sum("visits").over(whole(keys))
    baseline = F.sum(F.col("exit_prob") * F.col("visits")).over(whole(keys)) / F.when(visits > 0, visits)
    frame = rows.withColumns({"exit_baseline": baseline}).withColumn("exit_lift", C.ratio(F.col("exit_prob"), F.col("exit_baseline")))

    def mean(c: str):
        return F.sum(F.col(c) * F.col("visits")) / F.when(F.sum("visits") > 0, F.sum("visits"))

    headline = solved.groupBy(*keys).agg(
        mean("expected_steps").alias("mean_expected_steps"), mean("exit_prob").alias("mean_exit_prob"), *[mean(h).alias(f"mean_{h}") for h in horizons], F.max("error").alias("error")
    )
    return Plan(frame, headline, _dwell(cubes.transition), (_thin_cells(cubes.transition),), "state", {"kind": "bar", "x": "state"}, (*keys, "state"), errors=True)


@analysis("reachability")
def reachability(cubes: CubeSet, keys: Keys = (), source: str = "", target: str = "", max_k: int = 10) -> Plan:
    """Chance to have reached ``target`` from ``source`` within 1 to ``max_k`` steps."""
    cubes.need("reachability", "transition")
    if max_k < 1:
        raise ValueError(f"max_k is at least 1, not {max_k}")
    if source == target:
        raise ValueError(f"source and target are both {source!r}: being there already is certain at every step")
    solved = markov.hit_curve(cubes.transition, source, target, max_k, keys)
    frame = solved.where("error is null").select(*keys, F.lit(source).alias("source"), F.lit(target).alias("target"), "k", "p_hit_within")
    headline = solved.groupBy(*keys).agg(F.max(F.when(F.col("k") == max_k, F.col("p_hit_within"))).alias(f"p_hit_within_{max_k}"), F.max("error").alias("error"))
    return Plan(frame, headline, _dwell(cubes.transition), (_thin_cells(cubes.transition),), "k", {"kind": "line", "x": "k"}, (*keys, "k"), errors=True)


@analysis("screen_pair_affinity")
def screen_pair_affinity(cubes: CubeSet, keys: Keys = ()) -> Plan:
    """How much more often than by chance one state follows another; counts come along, as thin cells jump most."""
    cubes.need("screen_pair_affinity", "transition")
    pmi = markov.pointwise_information(cubes.transition, keys)
    headline = pmi.groupBy(*keys).agg(F.sum(F.col("joint") * F.col("pmi")).alias("mutual_information"), _num(F.count(F.lit(1))).alias("pairs"))
    return Plan(pmi.drop("joint"), headline, None, (_thin_cells(cubes.transition),), None, {"kind": "heatmap", "x": "from_state"}, (*keys, "-pmi", "from_state", "to_state"))


@analysis("screen_transition")
def screen_transition(cubes: CubeSet, keys: Keys = ()) -> Plan:
    """Seen transitions with their probability."""
    cubes.need("screen_transition", "transition")
    p = markov.probabilities(cubes.transition, keys).select(*keys, "from_state", "to_state", "prob", "cnt")
    pairs = p.groupBy(*keys).agg(_num(F.count(F.lit(1))).alias("pairs"))
    n = markov.states(cubes.transition, keys).groupBy(*keys).agg(_num(F.count(F.lit(1))).alias("states"))
    return Plan(p, _joined(pairs, n, keys), None, (_thin_cells(cubes.transition),), None, {"kind": "heatmap", "x": "from_state", "value": "prob"}, (*keys, "-cnt", "from_state", "to_state"))


@analysis("hub_neighbors")
def hub_neighbors(cubes: CubeSet, keys: Keys = (), screen: str = "") -> Plan:
    """Where sessions come from to a screen and go to from it; without a screen, that of the highest page rank."""
    cubes.need("hub_neighbors", "transition")
    edges = markov.counts(cubes.transition, keys)
    if screen:
        hub = edges.groupBy(*keys).agg(F.lit(screen).alias("hub"))
    else:
        ranks = markov.flow(cubes.transition, keys)
        hub = ranks.where("state is not null").groupBy(*keys).agg(F.min_by("state", F.struct(-F.col("pagerank"), F.col("state"))).alias("hub"))
    rows = edges.join(F.broadcast(hub), list(keys)) if keys else edges.crossJoin(F.broadcast(hub))
    sides = F.array(
        F.struct(F.lit("OUT").alias("direction"), F.col("to_state").alias("neighbor"), (F.col("from_state") == F.col("hub")).alias("on")),
        F.struct(F.lit("IN").alias("direction"), F.col("from_state").alias("neighbor"), (F.col("to_state") == F.col("hub")).alias("on")),
    )
    near = rows.select(*keys, "hub", "cnt", F.explode(sides).alias("s")).where("s.on").select(*keys, "hub", "s.direction", "s.neighbor", "cnt")
    frame = near.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*keys, "direction")))
    way = F.col("direction")
    found = frame.groupBy(*keys).agg(
        _num(F.count_if(way == "IN")).alias("in_degree"), _num(F.count_if(way == "OUT")).alias("out_degree"),
        F.max(F.when(way == "IN", F.col("share"))).alias("in_top_share"), F.max(F.when(way == "OUT", F.col("share"))).alias("out_top_share"),
    )
    if screen and not keys:
        found = found.withColumn("error", F.when(F.col("in_degree") + F.col("out_degree") == 0, F.lit(f"unknown screen: {screen!r}")))
        return Plan(frame, found, None, (_thin_cells(cubes.transition),), None, {"kind": "table"}, ("direction", "-cnt", "neighbor"), errors=True)
    return Plan(frame, found, None, (_thin_cells(cubes.transition),), None, {"kind": "table"}, (*keys, "direction", "-cnt", "neighbor"))


@analysis("cross_service_flow")
def cross_service_flow(cubes: CubeSet, keys: Keys = ()) -> Plan:
    """Movement between services, from screen to screen only."""
    cubes.need("cross_service_flow", "transition")
    rows = cubes.transition.withColumns({"from_service": C.service_of(F.col("from_state")), "to_service": C.service_of(F.col("to_state"))}).where("from_service is not null and to_service is not null")
    own = rows.groupBy(*keys, "from_service", "to_service").agg(F.sum("cnt").alias("cnt"))
    frame = own.withColumn("share_of_origin", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*keys, "from_service")))
    switch = F.when(F.col("from_service") != F.col("to_service"), F.col("cnt"))
    parts = own.withColumn("_p", switch / F.sum(switch).over(whole(keys)))
    headline = parts.groupBy(*keys).agg(
        C.ratio(F.coalesce(F.sum(switch), F.lit(0)), F.sum("cnt")).alias("cross_service_share"), F.coalesce(F.sum(F.when(F.col("_p") > 0, C.information(F.col("_p")))), F.lit(0.0)).alias("switch_entropy")
    )
    return Plan(frame, headline, None, (_thin_cells(cubes.transition),), None, {"kind": "heatmap", "x": "from_service"}, (*keys, "-cnt", "from_service", "to_service"))


def _communities(edges: DataFrame, keys: Keys, seed: int, resolution: float) -> DataFrame:
    on = edges.where(~markov.is_end("from_state") & ~markov.is_end("to_state"))

    def solve(chain_edges: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(chain_edges["from_state"], chain_edges["to_state"], chain_edges["cnt"].astype(float), strict=True))
        of = louvain.communities(rows, seed, resolution)
        g = louvain.undirected(rows)
        deg, q = louvain.degrees(g), louvain.modularity(g, of, 1.0)
        size = pd.Series(list(of.values())).value_counts()
        names = sorted(of)
        out = pd.DataFrame({"state": names, "community": [of[s] for s in names], "degree": [deg[s] for s in names], "community_size": [int(size[of[s]]) for s in names], "modularity": q})
        for n, k in enumerate(keys):
            out.insert(n, k, chain_edges[k].iloc[0])
        return out

    c = markov.counts(on, keys)
    kinds = {f.name: f.dataType.simpleString() for f in c.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "state string, community int, degree double, community_size int, modularity double"])
    return c.groupBy(*(list(keys) or [F.lit(0).alias("_one")])).applyInPandas(solve, schema)


@analysis("screen_communities")
def screen_communities(cubes: CubeSet, keys: Keys = (), seed: int = 0, resolution: float = 1.0) -> Plan:
    """Screens between which sessions go back and forth; START and EXIT, which touch everything, are left out."""
    cubes.need("screen_communities", "transition")
    rows = _communities(cubes.transition, keys, seed, resolution)
    headline = rows.groupBy(*keys).agg(_num(F.max("community") + 1).alias("communities"), F.max("modularity").alias("modularity"))
    return Plan(rows.drop("modularity"), headline, _dwell(cubes.transition), (), "state", {"kind": "graph", "x": "state", "group": "community"}, (*keys, "state"))


@analysis("community_paths")
def community_paths(cubes: CubeSet, keys: Keys = (), seed: int = 0, resolution: float = 1.0, top_per_community: int = 10) -> Plan:
    """Most walked five-step paths that stay within one community."""
    cubes.need("community_paths", "path", "transition")
    of = _communities(cubes.transition, keys, seed, resolution).select(*keys, "state", "community")
    ranked = measures.paths_within(cubes.path, of, keys=keys)
    frame = ranked.where(F.col("rank") <= top_per_community)
    headline = ranked.groupBy(*keys).agg(
        _num(F.count_distinct("community")).alias("communities_covered"), _num(F.count(F.lit(1))).alias("within_community_5grams"), F.max(F.when(F.col("rank") <= top_per_community, F.col("support_in_comm"))).alias("top_support")
    )
    return Plan(frame, headline, None, (), None, {"kind": "table"}, (*keys, "community", "rank"))


@analysis("quality_report")
def quality_report(cubes: CubeSet, keys: Keys = (), thresholds: dict[str, float] | None = None) -> Plan:
    """Violations of each check by day, and what is over its limit by service and day."""
    from pathloom.plans.cubes import CHECKS
    from pathloom.sources.settings import QUALITY_LIMITS

    cubes.need("quality_report", "quality")
    limits = QUALITY_LIMITS if thresholds is None else thresholds
    frame = measures.quality_ratios(cubes.quality, keys=keys)
    at_exit = F.col("check_name") == EXIT_CHECK
    headline = frame.groupBy(*keys).agg(
        *[F.max(F.when(F.col("check_name") == c, F.col("ratio"))).alias(f"worst_{c}") for c in CHECKS],
        (1 - C.ratio(F.sum(F.when(at_exit, F.col("violated"))), F.sum(F.when(at_exit, F.col("total"))))).alias("exit_corroboration"),
    )
    over = measures.quality_warnings(cubes.quality, limits).orderBy(F.desc("ratio"), "check_name", "period")
    coverage = measures.screen_coverage(cubes.quality).withColumnRenamed("screen_coverage", "screen")
    return Plan(frame, headline, coverage, (over,), "check_name", {"kind": "line", "x": "period"}, (*keys, "check_name", "period"))


@analysis("click_distribution")
def click_distribution(cubes: CubeSet, keys: Keys = (), by: Sequence[str] = ("action_kind",)) -> Plan:
    """What is clicked on each screen, as shares within the screen."""
    cubes.need("click_distribution", "action")
    frame = measures.click_share(cubes.action, by, keys)
    lost = F.sum(F.when(markov.is_end("screen"), F.col("cnt")).otherwise(0))
    clicks = cubes.action.groupBy(*keys).agg(_num(F.sum("cnt")).alias("clicks"), lost.alias("_lost"))
    if cubes.transition is not None:
        visits = cubes.transition.where(~markov.is_end("from_state")).groupBy(*keys).agg(F.sum("cnt").alias("_visits"))
        clicks = _joined(clicks, visits, keys)
    else:
        clicks = clicks.withColumn("_visits", F.lit(None).cast("long"))
    headline = clicks.select(
        *keys, "clicks", C.ratio(F.col("clicks") - F.col("_lost"), F.col("_visits")).alias("clicks_per_visit"), C.ratio(F.col("_lost"), F.col("clicks")).alias("unattributed_share")
    )
    warning = headline.where(F.col("unattributed_share") > UNATTRIBUTED_WARN_ABOVE).select(
        F.lit("clicks_without_a_screen").alias("check_name"), F.col("unattributed_share").alias("ratio"), F.lit(UNATTRIBUTED_WARN_ABOVE).alias("threshold")
    )
    return Plan(frame, headline, None, (warning,), "screen", {"kind": "bar", "x": "screen"}, (*keys, "screen", "-cnt", *by))


@analysis("conditional_flow")
def conditional_flow(cubes: CubeSet, keys: Keys = ()) -> Plan:
    """Where a click of some kind leads.  ``action_information``: what the kind tells of the next screen, the screen being known.

    Pairs without a click are in the frame but not in that figure: not clicking
    is no kind of click.
    """
    cubes.need("conditional_flow", "cond_transition")
    own = cubes.cond_transition.groupBy(*keys, "from_state", "action_kind", "to_state").agg(F.sum("cnt").alias("cnt"))
    frame = own.withColumn("share_of_origin", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*keys, "from_state", "action_kind")))
    acted = own.where(F.col("action_kind") != C.NO_CLICK)
    # I(next; kind | screen) = sum over pairs of p * ln(p(next | screen, kind) / p(next | screen)).
    w = lambda *c: F.sum("cnt").over(Window.partitionBy(*keys, *c)) if (keys or c) else F.sum("cnt").over(whole(keys))
    parts = acted.withColumns({"_k": w("from_state", "action_kind"), "_n": w("from_state", "to_state"), "_s": w("from_state"), "_t": w()})
    gain = F.col("cnt") / F.col("_t") * F.ln(F.col("cnt") * F.col("_s") / (F.col("_k") * F.col("_n")))
    info = parts.groupBy(*keys).agg(F.sum(gain).alias("action_information"))
    quiet = own.groupBy(*keys).agg(F.sum(F.when(F.col("action_kind") == C.NO_CLICK, F.col("cnt")).otherwise(0)).alias("_quiet"))
    headline = _joined(quiet, info, keys)
    if cubes.transition is not None:
        headline = _joined(headline, cubes.transition.groupBy(*keys).agg(F.sum("cnt").alias("_all")), keys)
    else:
        headline = headline.withColumn("_all", F.lit(None).cast("long"))
    headline = headline.select(*keys, "action_information", C.ratio(F.col("_quiet"), F.col("_all")).alias("no_click_share"))
    return Plan(frame, headline, None, (), "from_state", {"kind": "heatmap", "x": "from_state"}, (*keys, "-cnt", "from_state", "action_kind", "to_state"))


@analysis("path_ranking")
def path_ranking(cubes: CubeSet, keys: Keys = (), n: int | None = None) -> Plan:
    """Most walked paths of ``n`` screens, with the size of the cut."""
    cubes.need("path_ranking", "path")
    frame = measures.top_paths(cubes.path, n, keys)
    cover = measures.path_coverage(cubes.path, n, keys)
    ranked = frame.groupBy(*keys).agg(_num(F.count(F.lit(1))).alias("paths"), F.max("share").alias("top_path_share"))
    headline = _joined(cover, ranked, keys).select(*keys, F.lit(float(n)).alias("n"), "coverage", _num(F.col("distinct_dropped")).alias("distinct_dropped"), F.coalesce("paths", F.lit(0.0)).alias("paths"), "top_path_share")
    tail = cover.where(1 - F.col("coverage") > measures.TAIL_DOMINATES).select(F.lit("path_tail_dominates").alias("check_name"), (1 - F.col("coverage")).alias("ratio"), F.lit(measures.TAIL_DOMINATES).alias("threshold"))
    return Plan(frame, headline, None, (tail,), "path", {"kind": "bar", "x": "path"}, (*keys, "-cnt", "path"))


def _contexts(cubes: CubeSet, keys: Keys, order: int) -> tuple[DataFrame, DataFrame]:
    """(keys, context, cur, next_state, cnt, total, p, first): paths of order + 1 screens beside the first-order prediction; and the rows that could not be split."""
    n = order + 1
    rows = cubes.path.where((F.col("n") == n) & (F.col("path") != C.TAIL)).withColumn("_s", F.split("path", ">"))
    bad = rows.where(F.size("_s") != n).agg(F.count(F.lit(1)).alias("rows")).where("rows > 0").select(F.lit("unparsable_path").alias("check_name"), "rows")
    grams = rows.where(F.size("_s") == n).groupBy(
        *keys, F.array_join(F.slice("_s", 1, order), ">").alias("context"), F.element_at("_s", 1).alias("prev_state"), F.element_at("_s", order).alias("cur"), F.element_at("_s", n).alias("next_state")
    ).agg(F.sum("cnt").alias("cnt"))
    # The prediction is that of the transition cube, sessions that end included.
    pair = cubes.transition.groupBy(*keys, "from_state", "to_state").agg(F.sum("cnt").alias("_c"))
    first = pair.select(*keys, F.col("from_state").alias("cur"), F.col("to_state").alias("next_state"), (F.col("_c") / F.sum("_c").over(Window.partitionBy(*keys, "from_state"))).alias("first"))
    per = Window.partitionBy(*keys, "context")
    out = grams.join(first, [*keys, "cur", "next_state"], "left").withColumn("total", F.sum("cnt").over(per)).withColumn("p", F.col("cnt") / F.col("total"))
    return out, bad


def _divergence():
    """KL of the seen next states from the prediction; null if none of them is predicted."""
    return F.sum(F.when(F.col("first") > 0, F.col("p") * F.ln(F.col("p") / F.col("first"))))


@analysis("markov_order_test")
def markov_order_test(cubes: CubeSet, keys: Keys = ()) -> Plan:
    """Does the screen before the current one tell more about the next?  0: one screen is enough."""
    cubes.need("markov_order_test", "path", "transition")
    rows, bad = _contexts(cubes, keys, 2)
    origins = cubes.transition.select(*keys, F.col("from_state").alias("cur")).distinct()
    known = rows.join(origins, [*keys, "cur"], "left_semi")
    frame = known.groupBy(*keys, "prev_state", F.col("cur").alias("state")).agg(F.sum("cnt").alias("cnt"), _divergence().alias("divergence"))
    mass = F.sum("cnt")
    scores = frame.groupBy(*keys).agg(
        C.ratio(F.sum(F.col("divergence") * F.col("cnt")), mass).alias("excess_information"), _num(F.count(F.lit(1))).alias("contexts"),
        C.ratio(F.sum(F.when(F.col("divergence") > CONTEXT_DIVERGES, F.col("cnt")).otherwise(0)), mass).alias("diverging_context_share"),
    )
    headline = _joined(measures.path_coverage(cubes.path, 3, keys).drop("distinct_dropped"), scores, keys).select(*keys, "excess_information", F.coalesce("contexts", F.lit(0.0)).alias("contexts"), "coverage", "diverging_context_share")
    return Plan(frame, headline, None, (bad,), "state", {"kind": "bar", "x": "state"}, (*keys, "-cnt", "prev_state", "state"))


@analysis("markov_order_flow")
def markov_order_flow(cubes: CubeSet, keys: Keys = (), order: int = 2, min_context: int = 1000) -> Plan:
    """Contexts in which knowing more screens changes the most likely next one."""
    cubes.need("markov_order_flow", "path", "transition")
    rows, bad = _contexts(cubes, keys, int(order))
    # Ties go to the first next state by name.
    lowest = Window.partitionBy(*keys, "context")
    rows = rows.withColumns({
        "_by_seen": F.row_number().over(lowest.orderBy(F.desc("cnt"), "next_state")), "_by_first": F.row_number().over(lowest.orderBy(F.desc_nulls_last("first"), "next_state")),
    })
    full = rows.groupBy(*keys, "context").agg(
        F.sum("cnt").alias("cnt"), F.max(F.when((F.col("_by_first") == 1) & F.col("first").isNotNull(), F.col("next_state"))).alias("top1_next"),
        F.max(F.when(F.col("_by_seen") == 1, F.col("next_state"))).alias("top_order_next"), _divergence().alias("divergence"),
    ).withColumn("argmax_flips", F.coalesce(F.col("top1_next") != F.col("top_order_next"), F.lit(False)))
    mass = F.sum("cnt")
    scores = full.groupBy(*keys).agg(
        C.ratio(F.sum(F.col("divergence") * F.col("cnt")), mass).alias("excess_information"), C.ratio(F.sum(F.when(F.col("argmax_flips"), F.col("cnt")).otherwise(0)), mass).alias("flip_share"),
        _num(F.count_if(F.col("cnt") >= min_context)).alias("contexts"),
    )
    cover = measures.path_coverage(cubes.path, int(order) + 1, keys).drop("distinct_dropped")
    headline = _joined(cover, scores, keys).select(*keys, F.lit(float(order)).alias("order"), "excess_information", "flip_share", F.coalesce("contexts", F.lit(0.0)).alias("contexts"), "coverage")
    frame = full.where(F.col("cnt") >= min_context).select(*keys, "context", "cnt", "top1_next", "top_order_next", "argmax_flips", "divergence")
    return Plan(frame, headline, None, (bad,), None, {"kind": "bar", "x": "context"}, (*keys, "-cnt", "context"))
