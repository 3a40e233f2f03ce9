import json

import pytest
from conftest import DAY, row
from pyspark.sql import functions as F

from pathloom.plans import vocabulary as V
from pathloom.sources import events as E
from pathloom.sources import settings
from pathloom.sources.store import check_day, key_of

NESTED_SCHEMA = (
    "user struct<uuid:string,suid:string>, common struct<access_time:string,service_type:string,page:string>, action struct<type:string,kind:string,name:string>, click struct<layer1:string,layer2:string>,"
    "usage struct<duration:string>, env struct<os:string,app_version:string>, date struct<daypart:string>, tag struct<is_invalid:string>, date_id string, c_service_code string"
)


def nested(spark, **change):
    base = {
        "user": ("u", "s"), "common": ("2026-07-27 10:00:00", " ", "p"), "action": ("Pageview", "ViewPage", "H"), "click": (None, None), "usage": ("12x",), "env": ("iOS", "1.0"),
        "date": ("",), "tag": (None,), "date_id": DAY, "c_service_code": "top",
    }
    r = base | change
    return spark.createDataFrame([tuple(r[k] for k in base)], NESTED_SCHEMA)


def test_nested_log(spark):
    dim = spark.createDataFrame([("u", "F", 0), ("u", "F", 0)], "uuid string, gender string, service_age_band int")
    out = E.canonical(nested(spark), dim).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["service_type"], r["os"], r["daypart"], r["gender"], r["age_band"], r["usage_duration_ms"], r["is_valid"]) == ("unknown", "ios", "unknown", "F", "unknown", None, True)


@pytest.mark.parametrize(("change", "kept", "ok"), [({"user": (" ", "s")}, 0, None), ({"common": ("no time", "MA", "p")}, 1, False), ({"tag": ("1",)}, 1, False), ({"tag": ("0",)}, 1, True)])
def test_base_filters(spark, change, kept, ok):
    out = E.canonical(nested(spark, **change), None).collect()
    assert len(out) == kept and (not kept or out[0]["is_valid"] is ok)


def test_a_scan_is_bounded(spark, tmp_path):
    path = str(tmp_path / "log")
    nested(spark).write.partitionBy("date_id", "c_service_code").parquet(path)
    log = spark.read.parquet(path)
    for days, services in (([], ["top"]), ([DAY], [])):
        with pytest.raises(E.UnboundedScanError):
            E.scan(log, days, services)
    plan = E.canonical(E.scan(log, [DAY], ["top"]), None)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cast(date_id" in plan or "PartitionFilters: [date_id" in plan or ("PartitionFilters: [" in plan and "date_id" in plan.split("PartitionFilters: [")[1][:200])


def test_windows():
    assert E.window_days(["2026-03-01"]) == ["2026-02-28", "2026-03-01", "2026-03-02"]
    with pytest.raises(ValueError):
        E.days_between("2026-07-28", "2026-07-27")


def test_sources_from_file(tmp_path, monkeypatch):
    p = tmp_path / "s.json"
    p.write_text(json.dumps([{"name": "log", "path": "/x", "filters": ["a = 1"], "secret_options": {"password": "PW"}}]))
    s = E.load_sources(str(p))["log"]
    assert s.filters == ("a = 1",)
    other = E.Source("log", "/x", filters=("a = 2",))
    assert s.version() != other.version()


@pytest.mark.parametrize(("counts", "ratio", "least", "want"), [
    ([("a", 90), ("b", 6), ("c", 4)], 0.95, 1, ["a", "b"]), ([("a", 50), ("b", 50)], 0.5, 1, ["a"]), ([("b", 50), ("a", 50)], 1.0, 1, ["a", "b"]), ([("a", 9), ("b", 1)], 1.0, 5, ["a"]), ([], 0.95, 1, []),
])
def test_cut(spark, counts, ratio, least, want):
    df = spark.createDataFrame(counts, "value string, cnt long")
    assert [r["value"] for r in V.cut(df, ratio, least).orderBy("rank").collect()] == want


def test_vocabulary_weighs_sessions_not_rows(events):
    rows = [row("pv", f"10:{i:02d}", "a") for i in range(9)] + [row("pv", "11:00", "b", suid=s) for s in ("x", "y")]
    got = {r["value"]: r["cnt"] for r in V.counts(events(*rows), "screens").collect()}
    assert got == {"top/a": 1, "top/b": 2}


def test_vocabulary_round_trip():
    v = V.StateDict(("a",), (), (), ("1",))
    assert V.StateDict.from_json(v.to_json(), v.version()) == v
    with pytest.raises(V.VocabularyMismatchError):
        V.StateDict.from_json(v.to_json().replace('"a"', '"b"'), v.version())


def test_keys_change_with_what_they_stand_for():
    v, w = V.StateDict(("a",), (), (), ()), V.StateDict(("b",), (), (), ())
    base = key_of("path", "s", ["top"], v, top=5)
    assert base != key_of("path", "s", ["top"], w, top=5) and base != key_of("path", "s", ["top"], v, top=6) and base != key_of("path", "s2", ["top"], v, top=5) and base != key_of("action", "s", ["top"], v)
    assert key_of("quality", "s", ["top"], v) == key_of("quality", "s", ["top"], w)
    assert key_of("path", "s", ["b", "a"], v, top=5) == key_of("path", "s", ["a", "b"], v, top=5)


def test_days_in_paths():
    for bad in ("../x", "2026-7-1", "2026-07-01/..", ""):
        with pytest.raises(ValueError):
            check_day(bad)


def test_settings(tmp_path):
    p = tmp_path / "x.json"
    p.write_text(json.dumps({"thresholds": {"a": {"limit": 0.1, "basis": "seen"}}}))
    assert settings.load_limits(str(p)) == {"a": 0.1}
    p.write_text(json.dumps({"thresholds": {"a": {"limit": 0.1}}}))
    with pytest.raises(ValueError):
        settings.load_limits(str(p))
    p.write_text(json.dumps({"app_versions": {"1": {"android": "2026-04-01", "ios": "2026-03-25"}, "2": {"ios": "2026-05-01"}}}))
    assert settings.load_releases(str(p)) == {"1": "2026-04-01", "2": "2026-05-01"}
    assert settings.load_releases(str(p), "android") == {"1": "2026-04-01"}
    p.write_text(json.dumps({"holidays": {"2026-01-01": "new year"}, "verified_windows": [["2026-01-01", "2026-01-31"]]}))
    assert settings.load_holidays(str(p)).verified == (("2026-01-01", "2026-01-31"),)


def test_flat_log_has_the_shape_it_should(spark):
    rows = E.flat_events(spark, "/root/testdata/sf0.001")
    assert rows.where("is_valid").count() == 992
    assert rows.where("is_valid").select("uuid").distinct().count() == 15
    assert rows.where(F.col("date_id") != F.date_format("ts", "yyyy-MM-dd")).where("is_valid").count() == 5
