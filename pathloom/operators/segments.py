"""Operators over analyses: compare two segments, decompose the difference, split by service.

Each puts all its slices on the cubes at once and runs the analysis a single
time with the slice as key; the number of days or strata does not change the
number of jobs.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.analyses import base
from pathloom.analyses.base import SLICE, CubeSet
from pathloom.functions import columns as C
from pathloom.operators import frames, measures

#: Stands between the parts of a slice's name; occurs in no axis value.
SEP = "\x1f"
POOLED = "*"


@dataclass(frozen=True)
class Comparison:
    """Pooled and daily relative differences a / b - 1 of every headline number."""

    pooled: dict[str, float]
    per_day: pd.DataFrame
    weight_skew: float
    dates_used: list[str]
    date_reason: str
    #: All days have one sign and the pooled difference has another.
    sign_disagrees: bool
    on: str
    a: str
    b: str
    analysis: str
    params: dict = field(default_factory=dict)
    envelope: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Decomposition:
    """``within`` + ``between`` is the pooled difference: what changed inside strata, and what comes from their mix."""

    within: float
    between: float
    per_stratum: pd.DataFrame
    composition: dict[str, float]


@dataclass(frozen=True)
class ServiceBreakdown:
    frame: pd.DataFrame
    pooled: dict[str, float]
    #: Pooled numbers that lie outside the range of the services' own.
    outside_range: dict[str, tuple[float, float]]
    cross_service_share: float
    services: list[str]


def volume(cubes: CubeSet) -> tuple[DataFrame, str]:
    """What weighs days and strata: transitions, else sessions in rows without roll-up."""
    if cubes.transition is not None:
        frame, measure = cubes.transition, "cnt"
    elif cubes.session is not None:
        frame, measure = frames.full_rows(cubes.session), "sessions"
    else:
        raise ValueError("nothing to compare on: the transition and session cubes are absent")
    if measure not in frame.columns:
        raise ValueError(f"the cube has no {measure!r} to weigh by")
    return frame, measure


def delta(a: Mapping[str, float], b: Mapping[str, float]) -> dict[str, float]:
    return {k: (a[k] / b[k] - 1.0 if b[k] else math.nan) for k in a if k in b}


def _has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def headlines(cubes: CubeSet, name: str, params: Mapping[str, object]) -> dict[str, dict[str, float]]:
    """The analysis' headline for every slice, in one run."""
    plan = base.get(name)(cubes, (SLICE,), **params)
    out = {}
    for r in plan.headline.collect():
        row = r.asDict()
        s = row.pop(SLICE)
        why = row.pop("error", None)
        out[s] = {k: math.nan if v is None else float(v) for k, v in row.items()} | ({"error": why} if why else {})
    return out


def _numbers(h: Mapping[str, object] | None) -> dict[str, float]:
    return {k: v for k, v in (h or {}).items() if k != "error"}


def compare(cubes: CubeSet, name: str, on: str, a: str, b: str, released: Mapping[str, str] | None = None, **params) -> Comparison:
    """Two values of an axis by any analysis, on days that both have, after both are released."""
    recorded = base.parameters(base.get(name), params)
    weights, measure = volume(cubes)
    days = measures.comparable_days(weights, on, a, b, released)
    scoped = cubes.filter(dates=days)

    def slices(df: DataFrame) -> Column:
        if not _has(df, on):
            # The cube does not know the axis: it stands for both sides.
            sides = F.array(F.lit(a), F.lit(b))
        else:
            sides = F.when(F.col(on).isin(a, b), F.array(F.col(on))).otherwise(F.array().cast("array<string>"))
        whens = F.array(F.lit(POOLED), F.col("period")) if _has(df, "period") else F.array(F.lit(POOLED))
        return F.flatten(F.transform(sides, lambda s: F.transform(whens, lambda w: F.concat(s, F.lit(SEP), w))))

    first = scoped.filter(**{on: a})
    got, env, skew = base.at_once(
        lambda: headlines(scoped.sliced(slices), name, params),
        lambda: base.envelope(first, base.get(name)(first, (), **params)),
        lambda: measures.weight_skew(measures.day_volumes(weights, on, a, b, days, measure)).first()[0],
    )
    pooled = delta(_numbers(got.get(f"{a}{SEP}{POOLED}")), _numbers(got.get(f"{b}{SEP}{POOLED}")))
    per_day = pd.DataFrame([{"period": d, **{f"delta_{k}": v for k, v in delta(_numbers(got.get(f"{a}{SEP}{d}")), _numbers(got.get(f"{b}{SEP}{d}"))).items()}} for d in days])
    disagrees = False
    for k, v in pooled.items():
        if f"delta_{k}" in per_day:
            signs = {(x > 0) - (x < 0) for x in per_day[f"delta_{k}"].dropna()}
            if len(signs) == 1 and not math.isnan(v) and ((v > 0) - (v < 0)) not in signs:
                disagrees = True
    reason = "days of both segments" + (", from the release on" if released and any(released.get(v) for v in (a, b)) else "")
    env |= {"present_dates": days, "comparison": {"on": on, "a": a, "b": b}}
    return Comparison(pooled, per_day, math.nan if skew is None else skew, days, reason, disagrees, on, a, b, name, recorded | dict(params), env)


def decompose(cubes: CubeSet, c: Comparison, by: Sequence[str], metric: str) -> Decomposition:
    """The comparison split by strata.  A stratum that one side lacks is reported without a difference."""
    if metric not in c.pooled:
        raise KeyError(f"{metric!r} is not in the comparison's headline: {', '.join(sorted(c.pooled))}")
    weights, measure = volume(cubes)
    scoped = cubes.filter(dates=c.dates_used)
    inside = F.col("period").isin(*c.dates_used)
    side = lambda v: F.sum(F.when(inside & (F.col(c.on) == v), F.col(measure)).otherwise(0)).cast("double")
    # All strata of the cube, those outside the comparison's days too.
    every = weights.groupBy(*by).agg(side(c.a).alias("a_cnt"), side(c.b).alias("b_cnt")).where(" and ".join(f"{k} is not null" for k in by)).orderBy(*by)

    def slices(df: DataFrame) -> Column:
        if not _has(df, c.on, *by):
            return F.array().cast("array<string>")
        return F.when(F.col(c.on).isin(c.a, c.b), F.array(F.concat_ws(SEP, F.col(c.on), *[F.col(k) for k in by]))).otherwise(F.array().cast("array<string>"))

    strata, got = base.at_once(every.toPandas, lambda: headlines(scoped.sliced(slices), c.analysis, c.params))
    out = []
    for r in strata.to_dict("records"):
        at = SEP.join(str(r[k]) for k in by)
        d = math.nan
        if r["a_cnt"] > 0 and r["b_cnt"] > 0:
            d = delta(_numbers(got.get(f"{c.a}{SEP}{at}")), _numbers(got.get(f"{c.b}{SEP}{at}"))).get(metric, math.nan)
        out.append(r | {"delta": d})
    per = pd.DataFrame(out)
    usable = per.dropna(subset=["delta"])
    total = usable["b_cnt"].sum()
    within = float((usable["delta"] * usable["b_cnt"]).sum() / total) if total > 0 else 0.0
    composition = {}
    for k in by:
        g = per.groupby(k)[["a_cnt", "b_cnt"]].sum()
        parts = g / g.sum().where(g.sum() > 0, 1)
        composition[k] = float((parts["a_cnt"] - parts["b_cnt"]).abs().sum() / 2)
    return Decomposition(within, float(c.pooled[metric] - within), per, composition)


def service_volumes(edges: DataFrame) -> DataFrame:
    """service, cnt, share of the steps from screens, other_share."""
    return measures.service_mix(edges).join(measures.other_share(edges), "service", "left").select("service", F.col("cnt").cast("double").alias("cnt"), "share", F.coalesce("other_share", F.lit(0.0)).alias("other_share"))


def crossing_share(edges: DataFrame) -> DataFrame:
    """Share of the steps from screen to screen that change the service."""
    a, b = C.service_of(F.col("from_state")), C.service_of(F.col("to_state"))
    rows = edges.where(a.isNotNull() & b.isNotNull())
    return rows.agg(C.ratio(F.coalesce(F.sum(F.when(a != b, F.col("cnt"))), F.lit(0)), F.sum("cnt")).alias("cross_service_share"))


def per_service(cubes: CubeSet, name: str, **params) -> ServiceBreakdown:
    """The analysis within each service: steps whose two ends are its screens, START or EXIT.

    A service whose slice cannot be computed stays in the table with the reason.
    """
    if cubes.transition is None:
        raise ValueError(f"{name!r} cannot be split by service: sessions span services, and only transitions tell them apart")
    base.parameters(base.get(name), params)
    edges = cubes.transition
    rows = service_volumes(edges).orderBy("service").toPandas()
    services = rows["service"].tolist()

    def slices(df: DataFrame) -> Column:
        none = F.array().cast("array<string>")
        if _has(df, "from_state", "to_state"):
            a, b = C.service_of(F.col("from_state")), C.service_of(F.col("to_state"))
            ends = F.col("from_state").isin(*C.ENDS) & F.col("to_state").isin(*C.ENDS)
            own = F.coalesce(a, b)
            fits = own.isNotNull() & ((a == b) | (a.isNull() & F.col("from_state").isin(*C.ENDS)) | (b.isNull() & F.col("to_state").isin(*C.ENDS)))
            every = F.array(*[F.lit(s) for s in services]).cast("array<string>")
            mine = F.when(ends, every).when(fits, F.array(own)).otherwise(none)
        else:
            mine = F.array("service_code") if _has(df, "service_code") else none
        return F.concat(mine, F.array(F.lit(POOLED)))

    # Of the cubes only transitions and quality are known by service.
    narrow = CubeSet(
        transition=cubes.transition, quality=cubes.quality if cubes.quality is not None and _has(cubes.quality, "service_code") else None, state_dict_version=cubes.state_dict_version,
        services=cubes.services, requested_dates=cubes.requested_dates, present_dates=cubes.present_dates,
    )

    def by_service() -> tuple[dict[str, dict], str]:
        try:
            return headlines(narrow.sliced(slices), name, params), ""
        except (ValueError, KeyError) as why:
            return {}, f"{type(why).__name__}: {why}"

    (got, failure), cross = base.at_once(by_service, lambda: crossing_share(edges).first()[0])
    whole = got.get(POOLED)
    if whole is None:
        # The analysis needs cubes that have no services, or there is nothing to split.
        row = base.get(name)(cubes, (), **params).headline.first()
        whole = base.numbers(row) | ({"error": row["error"]} if "error" in row and row["error"] is not None else {}) if row is not None else {}
    if whole.get("error"):
        raise ValueError(whole["error"])
    pooled = _numbers(whole)
    out = []
    for r in rows.to_dict("records"):
        h = got.get(r["service"], {"error": failure or "nothing to compute in this service"})
        out.append(r | ({"error": h["error"]} if h.get("error") else _numbers(h)))
    frame = pd.DataFrame(out)
    outside = {}
    for k, v in pooled.items():
        if k in frame.columns and frame[k].notna().any():
            lo, hi = float(frame[k].min()), float(frame[k].max())
            if v < lo or v > hi:
                outside[k] = (lo, hi)
    return ServiceBreakdown(frame, pooled, outside, math.nan if cross is None else cross, services)


__all__ = ["Comparison", "Decomposition", "ServiceBreakdown", "compare", "decompose", "per_service"]
