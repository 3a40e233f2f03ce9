"""Row-level meaning of the cubes: midnight, ties, dwell units, clicks, paths, checks."""

import pytest
from conftest import DAY, edges_of, row
from pyspark.sql import functions as F

from pathloom.functions import columns as C
from pathloom.plans import cubes as K
from pathloom.plans import sessions as S

H, CC = "top/H", "top/C"


def test_a_session_is_a_chain_from_start_to_exit(cube):
    assert edges_of(cube("transition", row("pv", "10:00", "H"), row("pv", "10:01", "C"))) == {("START", H): 1, (H, CC): 1, (CC, "EXIT"): 1}


def test_unlisted_screens_fold(cube):
    assert (H, "top/other") in edges_of(cube("transition", row("pv", "10:00", "H"), row("pv", "10:01", "X")))


def test_empty_vocabulary_folds_everything(cube):
    from pathloom.plans.vocabulary import StateDict

    out = edges_of(cube("transition", row("pv", "10:00", "H"), vocabulary=StateDict((), (), (), ())))
    assert out == {("START", "top/other"): 1, ("top/other", "EXIT"): 1}


def test_session_belongs_to_the_day_of_its_first_event(cube):
    rows = (row("pv", "2026-07-26 23:50", "H"), row("pv", "2026-07-27 00:10", "C"))
    assert cube("transition", *rows).count() == 0
    assert edges_of(cube("transition", *rows, days=("2026-07-26",)))[(H, CC)] == 1


def test_no_screen_no_edge(cube):
    assert cube("transition", row("other", "10:00")).count() == 0


def test_axes_are_those_of_the_first_event_of_any_kind(cube):
    out = cube("transition", row("other", "05:50"), row("pv", "06:10", "H")).select("daypart").distinct().collect()
    assert [r[0] for r in out] == ["night"]


def dwell(df):
    return {(r["from_state"], r["to_state"]): (r["dur_sum"], r["dur_n"]) for r in df.collect()}


def test_dwell_goes_to_the_screen_before_it_in_seconds(cube):
    out = dwell(cube("transition", row("pv", "10:00", "H"), row("usage", "10:01", usage_duration_ms=12000.0), row("pv", "10:02", "C"), row("usage", "10:03", usage_duration_ms=30000.0)))
    assert out == {(H, CC): (12.0, 1), (CC, "EXIT"): (30.0, 1), ("START", H): (0.0, 0)}


def test_several_measures_of_a_visit_are_one(cube):
    out = dwell(cube("transition", row("pv", "10:00", "H"), row("usage", "10:01", usage_duration_ms=5000.0), row("usage", "10:02", usage_duration_ms=7000.0), row("pv", "10:03", "C")))
    assert out[(H, CC)] == (12.0, 1)


def test_unmeasured_visit_and_dwell_before_any_screen(cube):
    assert dwell(cube("transition", row("pv", "10:00", "H"), row("pv", "10:01", "C")))[(H, CC)] == (0.0, 0)
    assert dwell(cube("transition", row("usage", "09:00", usage_duration_ms=99000.0), row("pv", "10:00", "H")))[(H, "EXIT")] == (0.0, 0)


def test_at_one_time_the_screen_comes_first(cube):
    out = dwell(cube("transition", row("pv", "09:00", "H"), row("usage", "10:00", usage_duration_ms=20000.0), row("pv", "10:00", "C")))
    assert out[(CC, "EXIT")] == (20.0, 1) and out[(H, CC)] == (0.0, 0)


def test_two_screens_at_one_time_are_two_visits(cube):
    assert sum(edges_of(cube("transition", row("pv", "10:00", "H"), row("pv", "10:00", "C"))).values()) == 3


@pytest.mark.parametrize(
    ("times", "want"),
    [(("2026-07-26 23:50", "2026-07-27 00:10"), 1), (("2026-07-26 23:00", "2026-07-27 12:00", "2026-07-28 01:00"), 1), (("2026-07-26 10:00", "2026-07-28 10:00"), 2)],
)
def test_sessions_over_days(cube, times, want):
    """The last case is a day's hole: each of the builds sees a part; kept as it is unless whole sessions are asked for."""
    days = ("2026-07-26", "2026-07-27", "2026-07-28")
    out = cube("session", *[row("pv", t, "H") for t in times], days=days)
    assert out.where("period is null").agg(F.sum("sessions")).first()[0] == want


def test_whole_sessions_close_the_hole(events, vocabulary):
    rows = events(row("pv", "2026-07-26 10:00", "H"), row("pv", "2026-07-28 10:00", "C"))
    out = S.session_rows(S.marked(rows, ["2026-07-26", "2026-07-27", "2026-07-28"], vocabulary, whole_sessions=True)).collect()
    assert [(r["period"], r["events"]) for r in out] == [("2026-07-26", 2)]


def test_two_suids_are_two_sessions(cube):
    assert cube("session", row("pv", "10:00", "H"), row("pv", "10:01", "H", suid="t")).where("period is null").first()["sessions"] == 2


def test_session_rollups(cube):
    out = cube("session", row("pv", "10:00", "H"), row("pv", "11:00", "H", suid="t", os="ios"))
    full = out.where(" and ".join(f"{a} is not null" for a in C.AXES))
    assert full.agg(F.sum("uv")).first()[0] == 2
    day = out.where("period is not null and os is null and gender is null").first()
    assert (day["uv"], day["sessions"]) == (1, 2)
    assert out.where("period is null").count() == 1


def test_late_partition_keeps_the_build_day(cube):
    out = cube("session", row("pv", "23:55", "H", date_id="2026-07-28"))
    assert {r["period"] for r in out.where("period is not null").collect()} == {DAY}


def clicks(df):
    return {(r["screen"], r["action_kind"], r["layer1"], r["layer2"]): r["cnt"] for r in df.collect()}


def test_clicks(cube):
    out = clicks(cube("action", row("click", "09:00"), row("pv", "10:00", "H"), row("click", "10:01"), row("click", "10:02", action_kind=None), row("other", "10:03"), row("click", "10:04", layer1="Z", layer2="Q")))
    assert out == {
        ("START", "ClickContent", "L", "L>(none)"): 1, (H, "ClickContent", "L", "L>(none)"): 1, (H, "(none)", "L", "L>(none)"): 1, (H, "ClickContent", "other", "other"): 1,
    }


def test_a_usage_row_with_a_slot_is_a_click(cube):
    assert clicks(cube("action", row("pv", "10:00", "H"), row("usage", "10:01", layer1="L")))[(H, "UsagePage", "L", "L>(none)")] == 1


def pairs(df):
    return {(r["from_state"], r["action_kind"], r["to_state"]): r["cnt"] for r in df.collect()}


def test_conditional_pairs(cube):
    assert pairs(cube("cond_transition", row("pv", "10:00", "H"), row("click", "10:01"), row("pv", "10:02", "C")))[(H, "ClickContent", CC)] == 1
    quiet = pairs(cube("cond_transition", row("pv", "10:00", "H"), row("pv", "10:02", "C")))
    assert quiet[(H, "(no_click)", CC)] == 1 and quiet[(CC, "(no_click)", "EXIT")] == 1
    unnamed = pairs(cube("cond_transition", row("pv", "10:00", "H"), row("click", "10:01", action_kind=" "), row("pv", "10:02", "C")))
    assert (H, "(none)", CC) in unnamed and (H, "(no_click)", CC) not in unnamed
    many = pairs(cube("cond_transition", row("pv", "10:00", "H"), row("click", "10:01"), row("click", "10:01:30"), row("click", "10:01:40", action_kind="Share"), row("pv", "10:02", "C")))
    assert many[(H, "ClickContent", CC)] == 2 and many[(H, "Share", CC)] == 1 and (H, "(no_click)", CC) not in many
    assert pairs(cube("cond_transition", row("click", "09:00"), row("pv", "10:00", "H")))[("START", "ClickContent", H)] == 1


def test_clicks_without_any_screen_count_as_clicks_only(cube):
    assert cube("cond_transition", row("click", "09:00")).count() == 0
    assert cube("action", row("click", "09:00")).count() == 1


def walk(names, suid="s", hour=10):
    return [row("pv", f"{hour}:{i:02d}", n, suid=suid) for i, n in enumerate(names)]


def paths(df, n):
    return {r["path"]: (r["cnt"], r["distinct_dropped"]) for r in df.where(F.col("n") == n).collect()}


def test_ngrams(cube):
    assert cube("path", *walk("ab")).count() == 0
    out = cube("path", *walk("abcd"))
    assert set(paths(out, 3)) == {"top/a>top/b>top/c", "top/b>top/c>top/d"} and set(paths(out, 4)) == {"top/a>top/b>top/c>top/d"} and not paths(out, 5)


def test_the_cut_keeps_the_total(cube):
    out = paths(cube("path", *walk("abcdef"), *walk("abc", "t"), *walk("cde", "v"), top=1), 3)
    assert out == {"top/a>top/b>top/c": (2, 0), "(other)": (4, 3)}


def test_ties_keep_the_first_path(cube):
    out = paths(cube("path", *walk("bcd"), *walk("abc", "t"), top=1), 3)
    assert set(out) == {"top/a>top/b>top/c", "(other)"}


def check(df, name):
    r = df.where(F.col("check_name") == name).collect()
    return [(x["violated"], x["total"]) for x in r]


def test_span_over_midnight_is_seen_on_the_first_day_only(cube):
    rows = (row("pv", "2026-07-27 22:00", "H"), row("pv", "2026-07-28 04:01", "H"))
    assert check(cube("quality", *rows), "session_span_exceeds_timeout") == [(1, 1)]
    assert check(cube("quality", *rows, days=("2026-07-28",)), "session_span_exceeds_timeout") == []


def test_quality_denominators(cube):
    out = cube("quality", row("pv", "10:00", "H", action_kind=None, page="p1"), row("pv", "10:01", "H", page="p2"), row("pv", "10:02", None), row("other", "10:03"), row("usage", "10:04", action_name="x"))
    assert check(out, "null_action_name") == [(1, 5)] and check(out, "pageview_null_kind") == [(1, 5)] and check(out, "screen_other_ratio") == [(1, 3)]
    assert check(out, "page_name_ambiguous") == [(1, 1)] and check(out, "screen_without_dwell") == [(2, 3)] and check(out, "session_no_screen") == [(0, 1)]
    assert check(out, "exit_without_appexit") == []


def test_exit_check_counts_app_sessions_only(cube):
    app = {"action_type": "App", "action_kind": "AppExit"}
    good = cube("quality", row("pv", "10:00", "H"), row("other", "10:01", **app))
    assert check(good, "exit_without_appexit") == [(0, 1)]
    bad = cube("quality", row("other", "09:00", **app), row("pv", "10:00", "H"))
    assert check(bad, "exit_without_appexit") == [(1, 1)]


def test_invalid_events_count_in_quality_alone(cube):
    bad = row("pv", "10:00", "H", is_valid=False)
    assert cube("transition", bad).count() == 0
    assert check(cube("quality", bad), "null_action_name") == [(0, 1)]


def test_empty_log(cube, spark):
    for name in K.CUBES:
        assert cube(name).count() == 0


@pytest.mark.parametrize("name", ["transition", "action", "path"])
def test_one_session_shuffle(events, vocabulary, name):
    """One exchange by user and one for the cube's aggregation (and one more for ranking in the path cube); no join."""
    plan = K.build(name, events(row("pv", "10:00", "H")), [DAY], vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(uuid") == 1
    assert "Join" not in plan
