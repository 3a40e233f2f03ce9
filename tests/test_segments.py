"""Comparisons: guards, Simpson's reversal, decomposition, services."""

import math

import pytest

from pathloom.analyses import CubeSet, base
from pathloom.operators import frames, measures, segments

DAYS = ("2026-07-26", "2026-07-27", "2026-07-28")


@pytest.fixture
def simpson(spark):
    """On each day version a leaves more rarely; a's traffic lies on the days when everyone leaves more."""
    rows = []
    for day, rate, (na, nb) in zip(DAYS, (0.2, 0.3, 0.6), ((100, 9000), (1000, 5000), (9000, 300)), strict=True):
        for v, n, r in (("a", na, rate * 0.95), ("b", nb, rate)):
            rows += [(day, v, "x/A", "EXIT", round(n * r)), (day, v, "x/A", "x/A", n - round(n * r))]
    df = spark.createDataFrame(rows, "period string, app_version string, from_state string, to_state string, cnt long")
    return CubeSet(transition=df.selectExpr("*", "0.0D dur_sum", "0L dur_n"))


def test_reversal_is_seen(simpson):
    c = segments.compare(simpson, "screen_flow", "app_version", "a", "b")
    assert (c.per_day["delta_mean_exit_prob"] < 0).all() and c.pooled["mean_exit_prob"] > 0
    assert c.sign_disagrees and c.weight_skew > 0.5 and c.dates_used == list(DAYS)


def test_each_delta_is_that_of_its_own_run(simpson):
    c = segments.compare(simpson, "screen_flow", "app_version", "a", "b")
    for day in DAYS:
        one = simpson.filter(dates=[day])
        a, b = (base.run("screen_flow", one.filter(app_version=v)).headline["mean_exit_prob"] for v in "ab")
        assert c.per_day.set_index("period")["delta_mean_exit_prob"][day] == pytest.approx(a / b - 1)


def test_parts_add_up(simpson):
    c = segments.compare(simpson, "screen_flow", "app_version", "a", "b")
    d = segments.decompose(simpson, c, ["period"], "mean_exit_prob")
    assert d.within + d.between == pytest.approx(c.pooled["mean_exit_prob"]) and d.within < 0
    assert d.composition["period"] == pytest.approx(c.weight_skew)
    with pytest.raises(KeyError):
        segments.decompose(simpson, c, ["period"], "nothing")


def test_strata_of_one_side_stay_visible(spark):
    rows = [("d", "a", "m", "x/A", "EXIT", 10), ("d", "b", "m", "x/A", "EXIT", 10), ("d", "b", "w", "x/A", "EXIT", 10), ("e", "b", "z", "x/A", "EXIT", 10)]
    cubes = CubeSet(transition=spark.createDataFrame(rows, "period string, app_version string, os string, from_state string, to_state string, cnt long").selectExpr("*", "0.0D dur_sum", "0L dur_n"))
    d = segments.decompose(cubes, segments.compare(cubes, "screen_flow", "app_version", "a", "b"), ["os"], "mean_exit_prob")
    got = {r["os"]: (r["a_cnt"], r["b_cnt"], r["delta"]) for r in d.per_stratum.to_dict("records")}
    assert got["m"] == (10, 10, 0) and got["w"][:2] == (0, 10) and math.isnan(got["w"][2]) and got["z"][:2] == (0, 0)


def volumes(spark, *rows):
    return spark.createDataFrame(list(rows), "period string, app_version string, cnt long")


def test_days_have_to_be_shared(spark):
    cube = volumes(spark, ("d1", "a", 1), ("d2", "a", 1), ("d2", "b", 1), ("d3", "b", 1))
    assert measures.comparable_days(cube, "app_version", "a", "b") == ["d2"]
    for args in (("app_version", "a", "c"), ("app_version", "a", "b", {"a": "d3"})):
        with pytest.raises(measures.ConfoundedComparisonError):
            measures.comparable_days(cube, *args)
    with pytest.raises(measures.ConfoundedComparisonError):
        measures.comparable_days(volumes(spark, ("d1", "a", 1), ("d2", "b", 1)), "app_version", "a", "b")
    with pytest.raises(KeyError):
        measures.comparable_days(cube, "colour", "a", "b")


def test_day_volumes(spark):
    cube = volumes(spark, ("d1", "a", 30), ("d1", "b", 10), ("d1", "c", 60), ("d2", "a", 10), ("d2", "b", 30))
    v = measures.day_volumes(cube, "app_version", "a", "b", ["d1", "d2"])
    assert {r["period"]: r["a_share"] for r in v.collect()} == {"d1": 0.3, "d2": 0.25}
    assert measures.weight_skew(v).first()[0] == pytest.approx(0.5)


def two_services(spark, *more):
    rows = [("START", "top/a", 10), ("top/a", "media/b", 90), ("media/b", "top/a", 80), ("top/a", "EXIT", 5), ("media/b", "EXIT", 5), *more]
    return CubeSet(transition=spark.createDataFrame(rows, "from_state string, to_state string, cnt long").selectExpr("*", "0.0D dur_sum", "0L dur_n"))


def test_pooled_chain_outside_the_services(spark):
    s = segments.per_service(two_services(spark), "screen_flow")
    assert s.services == ["media", "top"] and s.cross_service_share == 1.0
    assert s.frame.set_index("service")["mean_expected_steps"].to_dict() == pytest.approx({"media": 1.0, "top": 1.0})
    assert "mean_expected_steps" in s.outside_range and s.pooled["mean_expected_steps"] > 5


def test_a_service_that_cannot_be_computed_stays(spark):
    s = segments.per_service(two_services(spark, ("dead/x", "dead/x", 3)), "screen_flow")
    row = s.frame.set_index("service").loc["dead"]
    assert "KeyError" in row["error"] and math.isnan(row["mean_exit_prob"])


def test_sessions_cannot_be_split_by_service(spark):
    with pytest.raises(ValueError):
        segments.per_service(CubeSet(), "session_trend")


SESSION = "period string, service_type string, os string, gender string, age_band string, daypart string, app_version string, sessions long, uv long, pv long, events long, duration_sum long"


def session_rows(spark):
    full = [("d", "MA", os, "F", "30", "day", "1", n, n, 2 * n, 3 * n, 10 * n) for os, n in (("ios", 4), ("android", 6))]
    folded = [("d", "MA", None, "F", "30", "day", "1", 10, 9, 20, 30, 100), ("d", None, None, None, None, None, None, 10, 9, 20, 30, 100), (None,) * 7 + (10, 9, 20, 30, 100)]
    return spark.createDataFrame(full + folded, SESSION)


def test_users_come_from_the_rollup_alone(spark):
    cube = session_rows(spark)
    r = base.run("session_trend", CubeSet(session=cube))
    assert r.frame.first()["uv"] == 9 and r.headline["sessions"] == 10 and r.headline["pv_per_session"] == 2
    part = base.run("session_trend", CubeSet(session=cube).filter(os="ios"))
    assert part.frame.first()["uv"] is None and part.headline["sessions"] == 4
    assert [w["check_name"] for w in part.envelope["warnings"]] == ["uv_unavailable_for_this_slice"]


def test_frames(spark):
    cube = session_rows(spark)
    assert frames.full_rows(cube).count() == 2
    assert frames.rollup_rows(cube, ["os"], check=True).count() == 1
    with pytest.raises(frames.AmbiguousRollupError):
        frames.rollup_rows(cube.unionByName(cube), ["os"], check=True)
    with pytest.raises(KeyError):
        frames.rollup_rows(cube, ["colour"])
    with pytest.raises(frames.NonAdditiveMeasureError):
        frames.additive_sum(cube, ["os"], ["uv"])
    assert frames.segment(cube, {"os": ["ios", "android"]}).count() == 2
    with pytest.raises(KeyError):
        frames.segment(cube, {"colour": 1})
    assert frames.segment(cube, {"colour": 1}, skip_unknown=True).count() == 5
