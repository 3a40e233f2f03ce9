"""Closed forms and invariants of chains."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathloom.analyses import CubeSet, base
from pathloom.operators import louvain, markov, measures


def chain(*rows):
    return markov.Chain(pd.DataFrame(rows, columns=["from_state", "to_state", "cnt"]))


@pytest.mark.parametrize(("stay", "leave"), [(1, 4), (5, 5), (9, 1)])
def test_expected_steps(stay, leave):
    """A screen that is shown again with chance q keeps a session for 1 / (1 - q) steps; one that leads there takes one more."""
    c = chain(("door", "room", 7), ("room", "room", stay), ("room", "EXIT", leave))
    steps = dict(zip(c.names, c.expected_steps(), strict=True))
    assert steps["room"] == pytest.approx((stay + leave) / leave) and steps["door"] == pytest.approx(1 + steps["room"])


def test_a_trap_makes_steps_infinite():
    c = chain(("A", "EXIT", 9), ("A", "T", 1), ("B", "EXIT", 1), ("T", "T", 1))
    assert dict(zip(c.names, c.expected_steps(), strict=True)) == {"A": math.inf, "B": 1.0, "T": math.inf}


def test_no_exit():
    c = chain(("A", "B", 1), ("B", "A", 1))
    assert np.isinf(c.expected_steps()).all() and (c.exit_within(2) == 0).all()
    with pytest.raises(KeyError):
        c.absorption()


def test_states_stand_in_order():
    assert chain(("START", "b", 1), ("b", "a", 1), ("a", "EXIT", 1)).states == ["START", "a", "b", "EXIT"]


def test_leaving_exit_is_refused():
    with pytest.raises(ValueError):
        chain(("A", "EXIT", 1), ("EXIT", "A", 1)).exit_within(2)


@pytest.mark.parametrize("seed", range(25))
def test_random_chains(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(2, 7)
    names = [f"s{i}" for i in range(n)]
    rows = [(a, b, int(rng.integers(0, 20))) for a in names for b in names] + [(a, "EXIT", int(rng.integers(1, 20))) for a in names] + [("START", names[0], 5)]
    c = chain(*[r for r in rows if r[2]])
    assert c.p.sum(axis=1) == pytest.approx(1)
    pi = c.stationary()
    assert (pi > -1e-9).all() and pi.sum() == pytest.approx(1)
    assert (c.expected_steps() >= 1).all()
    assert c.absorption()[1] == pytest.approx(1)
    assert c.pagerank().sum() == pytest.approx(1)
    curve = c.hits("START", names[-1], 8)
    assert (np.diff(curve) >= -1e-12).all()


FLOW = [("START", "A", 100), ("A", "B", 60), ("A", "EXIT", 40), ("B", "EXIT", 60)]


def run(edges, name, rows, **params):
    cubes = CubeSet(transition=edges(*[(*r, 0.0, 0) for r in rows], columns="from_state string, to_state string, cnt long, dur_sum double, dur_n long"), requested_dates=("d1", "d2"), present_dates=("d1",))
    return base.run(name, cubes, **params)


def test_screen_flow(edges):
    r = run(edges, "screen_flow", FLOW, exit_within=(2,))
    rows = {x["state"]: x.asDict() for x in r.frame.collect()}
    assert rows["A"]["exit_prob"] == pytest.approx(0.4) and rows["B"]["exit_prob"] == pytest.approx(1)
    assert rows["A"]["expected_steps"] == pytest.approx(1.6) and rows["A"]["entropy"] == pytest.approx(0.673012, abs=1e-6) and rows["A"]["p_exit_within_2"] == pytest.approx(1)
    assert r.headline["mean_expected_steps"] == pytest.approx(1.375) and r.headline["mean_exit_prob"] == pytest.approx(0.625)
    assert rows["A"]["exit_lift"] == pytest.approx(0.64) and rows["B"]["exit_lift"] == pytest.approx(1.6)
    assert r.envelope["missing_dates"] == ["d2"] and not r.envelope["is_complete"]
    assert r.params == {"exit_within": [2], "damping": 0.85}


def test_even_choice(edges):
    rows = {x["state"]: x for x in markov.determinism(edges(("A", "B", 1), ("A", "C", 1), ("A", "D", 1))).collect()}
    assert rows["A"]["entropy"] == pytest.approx(math.log(3)) and rows["A"]["effective_choices"] == pytest.approx(3) and rows["A"]["top_to"] == "B"
    assert rows["D"]["out_degree"] == 0 and rows["D"]["entropy"] is None


def test_reachability_keeps_what_arrives(edges):
    rows = [("START", "A", 1), ("A", "B", 1), ("B", "A", 1), ("A", "EXIT", 1)]
    out = [x["p_hit_within"] for x in run(edges, "reachability", rows, source="START", target="B", max_k=4).frame.collect()]
    assert out == pytest.approx([0, 0.5, 0.5, 0.5])
    for bad in ({"source": "A", "target": "A"}, {"source": "A", "target": "B", "max_k": 0}, {"source": "A", "target": "nowhere"}):
        with pytest.raises((ValueError, KeyError)):
            run(edges, "reachability", rows, **bad)


def test_pairs_seen_more_than_by_chance(edges):
    r = run(edges, "screen_pair_affinity", [("A", "B", 1), ("C", "D", 1)])
    assert r.headline["mutual_information"] == pytest.approx(math.log(2)) and r.headline["pairs"] == 2


def test_cross_service(edges):
    rows = [("top/a", "top/b", 300), ("top/a", "media/b", 100), ("START", "top/a", 50), ("media/b", "EXIT", 5)]
    r = run(edges, "cross_service_flow", rows)
    assert r.headline == pytest.approx({"cross_service_share": 0.25, "switch_entropy": 0.0})


def test_hub(edges):
    r = run(edges, "hub_neighbors", FLOW, screen="A")
    assert {(x["direction"], x["neighbor"], x["cnt"]) for x in r.frame.collect()} == {("IN", "START", 100), ("OUT", "B", 60), ("OUT", "EXIT", 40)}
    assert r.headline["out_top_share"] == pytest.approx(0.6)
    with pytest.raises(ValueError):
        run(edges, "hub_neighbors", FLOW, screen="Z")
    assert run(edges, "hub_neighbors", FLOW).headline["in_degree"] >= 1


def test_service_names(edges):
    rows = edges(("top/a/b", "top/other", 3), ("top/other", "EXIT", 1), ("START", "top/a/b", 9), ("bare", "EXIT", 7))
    assert {r["service"]: r["share"] for r in measures.service_mix(rows).collect()} == {"top": 1.0}
    assert measures.other_share(rows).first()["other_share"] == 0.25


TRIANGLES = [(a, b, 10) for t in (("A", "B", "C"), ("X", "Y", "Z")) for a in t for b in t if a != b]


def test_two_triangles(edges):
    r = run(edges, "screen_communities", [*TRIANGLES, ("START", "A", 5), ("Z", "EXIT", 5)])
    assert {x["state"]: x["community"] for x in r.frame.collect()} == {"A": 0, "B": 0, "C": 0, "X": 1, "Y": 1, "Z": 1}
    assert r.headline["modularity"] == pytest.approx(0.5)


def test_modularity_of_a_given_split(spark, edges):
    rng = np.random.default_rng(5)
    rows = [(f"n{a}", f"n{b}", int(rng.integers(1, 30))) for a in range(9) for b in range(9) if rng.random() < 0.5]
    split = {f"n{a}": a % 3 for a in range(9)}
    of = spark.createDataFrame(list(split.items()), "state string, community int")
    got = measures.modularity(edges(*rows, ("START", "n1", 9), ("n2", "EXIT", 9), ("n3", "unknown", 4)), of, resolution=1.2).first()["modularity"]
    assert got == pytest.approx(louvain.modularity(louvain.undirected(rows), split, 1.2))
    sliced = edges(*[(k, *r) for k, part in (("p", rows), ("q", TRIANGLES)) for r in part], columns="slice string, from_state string, to_state string, cnt long")
    both = of.selectExpr("'p' AS slice", "*").unionByName(spark.createDataFrame([("q", s, s in "ABC") for s in "ABCXYZ"], "slice string, state string, community boolean").withColumn("community", F.col("community").cast("int")))
    assert {r["slice"]: r["modularity"] for r in measures.modularity(sliced, both, ("slice",)).collect()} == pytest.approx({"p": louvain.modularity(louvain.undirected(rows), split), "q": 0.5})
    assert measures.modularity(edges(), of).first() is None or measures.modularity(edges(), of).first()["modularity"] is None


def test_row_order_does_not_change_communities():
    rng = np.random.default_rng(3)
    rows = [(f"n{a}", f"n{b}", float(rng.integers(1, 30))) for a in range(12) for b in range(12) if rng.random() < 0.4]
    first = louvain.communities(rows, 0)
    assert louvain.communities(rows[::-1], 0) == first
    g = louvain.undirected(rows)
    assert louvain.modularity(g, first) >= louvain.modularity(g, {a: 0 for a in g}) - 1e-12


def test_unknown_names_and_parameters(edges):
    with pytest.raises(base.UnknownAnalysisError):
        base.get("nothing")
    with pytest.raises(TypeError):
        run(edges, "screen_flow", FLOW, colour="red")
    for name in base.names():
        with pytest.raises((ValueError, TypeError)):
            base.run(name, CubeSet(), **({"source": "a", "target": "b"} if name == "reachability" else {"n": 3} if name == "path_ranking" else {}))


PATH = "n int, path string, cnt long, distinct_dropped long"


def paths(spark, *rows):
    return spark.createDataFrame([(n, p, c, d) for n, p, c, d in rows], PATH)


def order_test(spark, edges, grams, pairs, name="markov_order_test", **params):
    cubes = CubeSet(path=paths(spark, *[(3, p, c, 0) for p, c in grams]), transition=edges(*pairs))
    return base.run(name, cubes, **params)


def test_one_screen_is_enough(spark, edges):
    r = order_test(spark, edges, [("A>B>C", 10), ("X>B>C", 10)], [("A", "B", 10), ("X", "B", 10), ("B", "C", 20)])
    assert r.headline["excess_information"] == pytest.approx(0)


def test_the_screen_before_decides(spark, edges):
    r = order_test(spark, edges, [("A>B>C", 50), ("X>B>D", 50)], [("B", "C", 50), ("B", "D", 50)])
    assert r.headline["excess_information"] == pytest.approx(math.log(2)) and r.headline["diverging_context_share"] == 1


def test_contexts_weigh_by_count(spark, edges):
    r = order_test(spark, edges, [("A>B>C", 90), ("X>B>C", 5), ("X>B>D", 5)], [("B", "C", 95), ("B", "D", 5)])
    assert r.headline["excess_information"] == pytest.approx(0.129201, abs=1e-6)


def test_unsplittable_paths_are_told(spark, edges):
    r = order_test(spark, edges, [("A>B>C", 9), ("A>B>C>D", 1)], [("B", "C", 1)])
    assert [w["check_name"] for w in r.envelope["warnings"]] == ["unparsable_path"]


def test_flips(spark, edges):
    r = order_test(spark, edges, [("A>B>C", 90), ("X>B>D", 10)], [("B", "C", 90), ("B", "D", 10)], name="markov_order_flow", min_context=1)
    # D is the only next state seen after X>B, so it is its first-order best as well.
    assert r.headline["flip_share"] == 0
    r = order_test(spark, edges, [("A>B>C", 90), ("X>B>D", 10), ("X>B>C", 4)], [("B", "C", 94), ("B", "D", 10)], name="markov_order_flow", min_context=1)
    assert r.headline["flip_share"] == pytest.approx(14 / 104)


def test_path_ranking(spark):
    cube = paths(spark, (3, "a>b>c", 50, 0), (3, "b>c>d", 30, 0), (3, "(other)", 20, 400), (4, "a>b>c>d", 10, 0), (4, "(other)", 90, 9))
    r = base.run("path_ranking", CubeSet(path=cube), n=3)
    assert r.headline == pytest.approx({"n": 3, "coverage": 0.8, "distinct_dropped": 400, "paths": 2, "top_path_share": 0.5})
    assert [w["check_name"] for w in base.run("path_ranking", CubeSet(path=cube), n=4).envelope["warnings"]] == ["path_tail_dominates"]
    for bad in (None, 2):
        with pytest.raises((ValueError, KeyError)):
            base.run("path_ranking", CubeSet(path=cube), n=bad)


def test_community_paths(spark, edges):
    cube = paths(spark, (5, "A>B>C>A>B", 8, 0), (5, "A>B>C>A>X", 5, 0), (5, "X>Y>Z>X>Y", 2, 0), (5, "(other)", 100, 7))
    r = base.run("community_paths", CubeSet(path=cube, transition=edges(*TRIANGLES)))
    assert {(x["community"], x["rank"], x["path"]) for x in r.frame.collect()} == {(0, 1, "A>B>C>A>B"), (1, 1, "X>Y>Z>X>Y")}
    assert r.headline["within_community_5grams"] == 2


COND = "from_state string, action_kind string, to_state string, cnt long"


@pytest.mark.parametrize(("rows", "want"), [
    ([("A", "x", "B", 50), ("A", "y", "C", 50)], math.log(2)), ([("A", "x", "B", 25), ("A", "x", "C", 25), ("A", "y", "B", 25), ("A", "y", "C", 25)], 0.0),
    ([("A", "x", "B", 50), ("A", "y", "C", 50), ("A", "(no_click)", "B", 900)], math.log(2)),
])
def test_what_a_click_tells(spark, edges, rows, want):
    r = base.run("conditional_flow", CubeSet(cond_transition=spark.createDataFrame(rows, COND), transition=edges(("A", "B", 1000))))
    assert r.headline["action_information"] == pytest.approx(want, abs=1e-12)


def test_click_distribution(spark, edges):
    action = spark.createDataFrame([("H", "c", 60), ("H", "s", 30), ("START", "c", 10)], "screen string, action_kind string, cnt long")
    r = base.run("click_distribution", CubeSet(action=action, transition=edges(("H", "EXIT", 50), ("START", "H", 50))))
    assert r.headline == pytest.approx({"clicks": 100, "clicks_per_visit": 90 / 50, "unattributed_share": 0.1})
    assert math.isnan(base.run("click_distribution", CubeSet(action=action)).headline["clicks_per_visit"])


def test_quality_ratio_is_of_sums(spark):
    q = spark.createDataFrame([("top", "1", "d", "session_no_screen", 255, 1000), ("media", "1", "d", "session_no_screen", 12, 4000)], "service_code string, app_version string, period string, check_name string, violated long, total long")
    r = base.run("quality_report", CubeSet(quality=q))
    assert r.frame.first()["ratio"] == pytest.approx(267 / 5000) and r.headline["worst_session_no_screen"] == pytest.approx(267 / 5000)
    assert [(w["service_code"], w["check_name"]) for w in r.envelope["warnings"]] == [("top", "session_no_screen")]
    assert r.envelope["coverage"]["screen"] == pytest.approx(1 - 267 / 5000) and r.envelope["service_mix"] == {"top": 0.2, "media": 0.8}


def test_dwell_is_over_measured_visits(edges):
    rows = edges(("A", "B", 10, 30.0, 3), ("B", "EXIT", 10, 0.0, 0), ("START", "A", 10, 0.0, 0), columns="from_state string, to_state string, cnt long, dur_sum double, dur_n long")
    r = base.run("screen_dwell_rank", CubeSet(transition=rows))
    got = {x["state"]: x for x in r.frame.collect()}
    assert got["A"]["seconds_per_visit"] == 10 and got["B"]["seconds_per_visit"] is None
    assert r.headline == pytest.approx({"mean_seconds_per_visit": 10, "dwell_coverage": 0.15})
    assert any(w["check_name"] == "low_dwell_coverage" for w in r.envelope["warnings"])


def test_day_kinds():
    assert measures.split_by_kind(["2026-07-18", "2026-07-17", "2026-07-16"], {"2026-07-17", "2026-07-18"}) == {"weekday": ["2026-07-16"], "weekend": [], "holiday": ["2026-07-17", "2026-07-18"]}
    with pytest.raises(measures.UnverifiedWindowError):
        measures.split_by_kind(["2027-01-01"], set(), [("2026-01-01", "2026-12-31")])


def test_thin_cells_are_told(edges):
    r = run(edges, "screen_transition", [("A", "B", 1), ("A", "C", 9), ("A", "D", 9)])
    w = next(w for w in r.envelope["warnings"] if w["check_name"] == "thin_transition_cells")
    assert (w["single_observation_edges"], w["median_cnt"]) == (1, 9.0) and w["share"] == pytest.approx(1 / 3)
