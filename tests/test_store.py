"""Building, keeping, loading, publishing and serving."""

import pytest
from conftest import row
from pyspark.sql import functions as F

from pathloom import serving
from pathloom.analyses import base
from pathloom.plans.builder import Builder
from pathloom.plans.cubes import CUBES
from pathloom.sources import results
from pathloom.sources.store import CubeNotBuiltError, IncompleteCubeError, SchemaMismatchError, Store

D = ("2026-07-26", "2026-07-27", "2026-07-28")


@pytest.fixture
def builder(spark, events, tmp_path):
    log = events(
        *[row("pv", f"{d} 10:00", "H") for d in D[:2]], *[row("click", f"{d} 10:01") for d in D[:2]], *[row("pv", f"{d} 10:02", "C") for d in D[:2]], row("pv", f"{D[1]} 12:00", "a", suid="t")
    ).cache()
    asked = []

    def scan(days, services):
        asked.append(tuple(days))
        return log.where(F.col("date_id").isin(*days) & F.col("service_code").isin(*services))

    b = Builder(Store(spark, f"file://{tmp_path}"), scan, ("top",), "v1")
    object.__setattr__(b, "asked", asked)
    return b


def test_build_load_and_build_again(builder):
    v = builder.vocabulary(D[0], D[1], min_count=1)
    assert set(v.screens) == {"top/H", "top/C", "top/a"}
    assert builder.store.load_vocabulary(v.version()) == v
    r = builder.build(D[0], D[1], v)
    assert not r.failed and all(r.built[n] == list(D[:2]) for n in CUBES)
    n = len(builder.asked)
    again = builder.build(D[0], D[1], v)
    assert len(builder.asked) == n and all(again.skipped[c] == list(D[:2]) for c in CUBES)
    cubes = builder.load(D[0], D[2], v, ("session", "transition", "quality"))
    assert cubes.present_dates == D[:2] and cubes.action is None
    assert base.run("screen_transition", cubes).envelope["missing_dates"] == [D[2]]
    assert builder.build(D[2], D[2], v).built["session"] == [D[2]]
    assert builder.load(D[0], D[2], v).session.where("period is null").count() == 2


def test_one_day_leaves_the_others_alone(builder):
    v = builder.vocabulary(D[0], D[1], min_count=1)
    builder.build(D[0], D[1], v, ("transition",))
    before = builder.load(D[0], D[0], v, ("transition",)).transition.collect()
    builder.build(D[1], D[1], v, ("transition",), refresh=True)
    assert builder.load(D[0], D[0], v, ("transition",)).transition.collect() == before


def test_what_is_not_built(builder):
    v = builder.vocabulary(D[0], D[1], min_count=1)
    key = builder.key("session", v)
    with pytest.raises(CubeNotBuiltError):
        builder.store.read("session", key, D)
    builder.build(D[0], D[0], v, ("session",))
    loaded = builder.store.read("session", key, D)
    assert loaded.missing == D[1:]
    with pytest.raises(IncompleteCubeError):
        loaded.require_complete()


def test_stops_at_the_first_failure(builder, monkeypatch):
    from pathloom.plans import builder as module

    v = builder.vocabulary(D[0], D[1], min_count=1)
    make = module.K.build

    def broken(name, *a, **k):
        if name == "action":
            raise RuntimeError("disk")
        return make(name, *a, **k)

    monkeypatch.setattr(module.K, "build", broken)
    r = builder.build(D[0], D[0], v)
    assert r.failed.startswith("action") and r.built["transition"] == [D[0]] and r.built["path"] == []


def test_other_columns_are_found(builder):
    v = builder.vocabulary(D[0], D[1], min_count=1)
    builder.build(D[0], D[0], v, ("transition",))
    key, store = builder.key("transition", v), builder.store
    odd = store.spark.createDataFrame([("x", D[1])], "other string, date string")
    with pytest.raises(SchemaMismatchError):
        store.write("transition", key, odd, D[1:2])
    assert store.read("transition", key, D[:2]).missing == D[1:2]
    store.write_text(f"{store.folder('transition', key)}/_columns.json", odd.drop("date").schema.json())
    with pytest.raises(SchemaMismatchError):
        store.read("transition", key, D[:1])


def test_a_day_built_again_without_rows_is_empty(builder):
    v = builder.vocabulary(D[0], D[1], min_count=1)
    builder.build(D[0], D[1], v, ("transition",))
    key, store = builder.key("transition", v), builder.store
    days = lambda: {r["date"] for r in store.read("transition", key, D[:2]).frame.select("date").collect()}
    rows = store.read("transition", key, D[:2]).frame.collect()
    assert days() == set(D[:2])
    store.write("transition", key, store.spark.createDataFrame([r for r in rows if r["date"] == D[1]], store.schema("transition")), D[:2])
    assert days() == {D[1]} and store.read("transition", key, D[:2]).present == D[:2]


def test_only_the_days_asked_for_are_listed(builder):
    v = builder.vocabulary(D[0], D[1], min_count=1)
    builder.build(D[0], D[1], v, ("session",))
    one = builder.store.read("session", builder.key("session", v), D[:1]).frame
    assert all(f"date={D[0]}" in f for f in one.inputFiles()) and one.inputFiles()


def test_publishing(builder):
    v = builder.vocabulary(D[0], D[1], min_count=1)
    builder.build(D[0], D[1], v)
    cubes, store = builder.load(D[0], D[2], v), builder.store
    r = base.run("click_distribution", cubes)
    key = results.publish(store, r, "run", "click_distribution", "Clicks")
    assert results.publish(store, r, "run", "click_distribution", "Clicks") == key
    record, frame = results.read_result(store, key)
    assert frame.count() == r.frame.count() and "1 days not built" in record["caveats"] and record["params"] == {"by": ["action_kind"]}
    assert [x["id"] for x in results.list_results(store, "run")] == [key] and not results.list_results(store, "other")
    with pytest.raises(results.ConflictingPublicationError):
        results.publish(store, base.run("click_distribution", cubes, by=("layer1",)), "run", "click_distribution", "Clicks")
    bare = base.AnalysisResult(r.frame, r.headline, {"services": []})
    with pytest.raises(results.IncompleteEnvelopeError):
        results.publish(store, bare, "run", "x", "y")
    assert results.register_skill(store, "a", {"v": 1}) and results.register_skill(store, "a", {"v": 2}) == {"a": {"v": 2}}


def test_cached_aggregates(builder):
    spark, calls = builder.store.spark, []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert results.cached(builder.store, "three", "v1", make).count() == 3
    results.cached(builder.store, "three", "v1", make, refresh=True)
    results.cached(builder.store, "three", "v2", make)
    assert len(calls) == 3


def test_serving(builder):
    v = builder.vocabulary(D[0], D[1], min_count=1)
    builder.build(D[0], D[1], v)
    out = serving.analyse(builder, v, "screen_flow", D[0], D[1], {"os": "android", "gender": ""}, {"exit_within": "2,3", "damping": " "}, page_size=2)
    # Session s walks H, C, H, C over two days: C leaves within three steps by 3/4, H by 1/2; session t shows a once.
    assert len(out["rows"]) == 2 and out["params"]["exit_within"] == [2, 3] and out["headline"]["mean_p_exit_within_3"] == pytest.approx((2 * 0.75 + 2 * 0.5 + 1) / 5)
    assert out["total_rows"] == 3 and out["chart"]["mark"]["type"] == "bar" and len(out["chart"]["data"]["values"]) == 3
    day = serving.compare(builder, v, "screen_flow", D[0], D[1], "os", "android", "android")
    assert day["pooled"]["mean_exit_prob"] == 0.0 and day["dates_used"] == list(D[:2])
    assert "reachability" in serving.meta(builder, v, D[0], D[1])["analyses"]
    with pytest.raises(serving.PeriodError):
        serving.check_period("2026-01-01", "2026-12-31")
    assert serving.check_period("2026-01-01", "2026-02-28")
    with pytest.raises(ValueError):
        serving.segment_of({"colour": "red"})
    assert serving.status_of(base.UnknownAnalysisError("x")) == 404 and serving.status_of(ValueError()) == 400 and serving.status_of(OSError()) == 500
    assert serving.plain({"a": float("nan"), "b": [float("inf"), 1.5]}) == {"a": None, "b": [None, 1.5]}
    assert serving.show(float("inf")) == "∞" and serving.show(1234.0) == "1,234" and serving.show(float("nan")) == ""


def test_pages_come_from_one_computation(builder, monkeypatch):
    v = builder.vocabulary(D[0], D[1], min_count=1)
    builder.build(D[0], D[1], v)
    ran, run = [], base.run
    monkeypatch.setattr(serving.base, "run", lambda *a, **k: ran.append(a[0]) or run(*a, **k))
    cache = serving.answers()
    pages = [serving.analyse(builder, v, "screen_transition", D[0], D[1], page=k, page_size=2, cache=cache) for k in (1, 2, 3)]
    whole = serving.analyse(builder, v, "screen_transition", D[0], D[1], page_size=100)
    assert ran == ["screen_transition"] * 2 and len(cache) == 1
    assert [r for p in pages for r in p["rows"]] == whole["rows"][:6] and {p["total_rows"] for p in pages} == {len(whole["rows"])}
    assert whole["chart"]["mark"] == "rect" and len(whole["chart"]["data"]["values"]) == len(whole["rows"])
    # Another segment is another answer; without room the older one's rows are deleted.
    cache.budget = 1
    old = next(iter(cache._values.values()))[1].frame
    serving.analyse(builder, v, "screen_transition", D[0], D[1], {"os": "android"}, cache=cache)
    assert len(cache) == 1
    with pytest.raises(Exception, match="(?i)exist"):
        old.collect()


def test_the_cache_keeps_to_its_budget():
    gone, made = [], []
    cache = serving.ByteCache(10, len, gone.append)

    def make(x):
        return lambda: made.append(x) or x

    for x in ("aaaa", "bbbb", "aaaa", "cccc", "aaaa"):
        assert cache.get(x, make(x)) == x
    assert made == ["aaaa", "bbbb", "cccc"] and gone == ["bbbb"] and cache.used == 8
    assert cache.get("big", make("x" * 50)) == "x" * 50 and len(cache) == 1 and cache.used == 50
    with pytest.raises(KeyError):
        cache.get("bad", lambda: {}["no"])
    assert cache.get("bad", make("fine")) == "fine" and cache.used == 4


def test_charts():
    from pyspark.sql import types as T

    schema = T._parse_datatype_string("period string, visits long, share double")
    rows = [{"period": "a", "visits": 1, "share": 0.5}, {"period": "b", "visits": 2, "share": None}]
    line = serving.chart_of({"kind": "line", "x": "period"}, schema, rows)
    assert line["data"]["values"] == [{"period": p, "series": c, "value": x} for c, xs in (("visits", (1, 2)), ("share", (0.5, None))) for p, x in zip("ab", xs, strict=True)]
    assert serving.chart_of({"kind": "bar", "x": "period"}, schema, rows * 30)["encoding"]["y"]["field"] == "visits"
    assert len(serving.chart_of({"kind": "bar", "x": "period"}, schema, rows * 30)["data"]["values"]) == serving.CHART_ROWS
    graph = serving.chart_of({"kind": "graph", "x": "state", "group": "community", "edges": [("p", "q", 4.0), ("q", "r", 1.0)]}, schema, [{"state": "p", "community": 0}, {"state": "q", "community": 11}])
    assert [e["width"] for e in graph["edges"]] == [5.0, 2.0] and graph["nodes"][1]["colour"] == serving.COLOURS[1]
    for odd in ({"kind": "table"}, {}, {"kind": "heatmap", "x": "period"}, {"kind": "bar", "x": "none"}):
        assert serving.chart_of(odd, schema, rows) is None


def test_http(builder):
    import json

    v = builder.vocabulary(D[0], D[1], min_count=1)
    builder.build(D[0], D[1], v)
    app = serving.application(builder, v, D[0], D[1])

    def ask(path, query="", method="GET"):
        got = []
        body = app({"PATH_INFO": path, "QUERY_STRING": query, "REQUEST_METHOD": method}, lambda status, headers: got.append(status))
        return int(got[0][:3]), json.loads(b"".join(body))

    status, said = ask("/api/meta")
    assert status == 200 and said["defaults"]["analysis"] == "session_trend" and {n for t in said["tabs"] for n in t["analyses"]} == set(base.names())
    flow = {p["name"]: p for p in said["analyses"]["screen_flow"]}
    assert flow["damping"] == {"name": "damping", "kind": "float", "required": False, "default": 0.85, "choices": []} and flow["exit_within"]["kind"] == "list of int"
    assert all(p["required"] and p["kind"] == "screen" for p in said["analyses"]["reachability"] if p["name"] in ("source", "target"))
    status, said = ask("/api/analysis/screen_flow", "os=android,ios&gender=&page=2&page_size=2&damping=0.5")
    assert status == 200 and said["total_rows"] == 3 and len(said["rows"]) == 1 and said["params"]["damping"] == 0.5
    assert ask("/api/compare/session_trend", "on=os&a=android&b=android")[0] == 200
    assert ask("/api/analysis/nothing")[0] == ask("/elsewhere")[0] == 404
    assert ask("/api/analysis/screen_flow", "page=0")[0] == ask("/api/analysis/screen_flow", "colour=red")[0] == ask("/api/compare/screen_flow")[0] == 400
    assert ask("/api/meta", method="POST")[0] == 405
    path, _, query = serving.link("screen_flow", D[0], D[1], {"os": ["android", "ios"], "gender": ""}, {"damping": "0.5", "exit_within": ""}, page=2).partition("?")
    assert serving.asked_of(query) == {"start": D[0], "end": D[1], "damping": "0.5", "os": "android,ios", "page": "2"}
    status, said = ask(path, query + "&page_size=2")
    assert status == 200 and said["total_rows"] == 3 and len(said["rows"]) == 1 and said["params"]["damping"] == 0.5
    path, _, query = serving.link("session_trend", D[0], D[1], between=("os", "android", "android")).partition("?")
    assert path == "/api/compare/session_trend" and ask(path, query)[0] == 200


def test_new_partitions_are_followed(builder, spark, tmp_path):
    from pathloom.streaming import daily

    v = builder.vocabulary(D[0], D[1], min_count=1)
    log = str(tmp_path / "log")
    builder.scan(D, ("top",)).where(F.col("date_id") == D[1]).write.mode("append").parquet(log)
    schema = spark.read.parquet(log).schema
    for _ in range(2):
        daily.follow(spark, log, schema, builder, v, str(tmp_path / "check"), ("transition",)).awaitTermination()
    assert daily.touched([D[1]]) == list(D)
    assert builder.load(D[0], D[2], v, ("transition",)).present_dates == D
