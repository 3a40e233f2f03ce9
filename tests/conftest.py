from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DAY = "2026-07-27"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def row(what: str, at: str, name: str | None = None, **more):
    """One event: pv, usage, click or other at HH:MM[:SS] or a full time."""
    when = at if len(at) > 8 else f"{DAY} {at}"
    ts = datetime.fromisoformat(when)
    kinds = {
        "pv": {"action_type": "Pageview", "action_kind": "ViewPage", "action_name": name}, "usage": {"action_type": "Usage", "action_kind": "UsagePage"},
        "click": {"action_type": "Event", "action_kind": "ClickContent", "layer1": "L"}, "other": {"action_type": "Event", "action_kind": None, "action_name": "telemetry"},
    }
    base = dict.fromkeys(("action_type", "action_kind", "action_name", "page", "layer1", "layer2", "usage_duration_ms"))
    base |= {
        "uuid": "u", "suid": "s", "ts": ts, "date_id": ts.date().isoformat(), "service_code": "top", "raw_version": "1.0", "service_type": "MA", "os": "android",
        "daypart": "night" if ts.hour < 6 else "day", "gender": "F", "age_band": "30", "is_valid": True,
    }
    return base | kinds[what] | more


@pytest.fixture
def events(spark):
    from pathloom.sources.events import EVENT_SCHEMA

    def make(*rows):
        names = EVENT_SCHEMA.fieldNames()
        return spark.createDataFrame([tuple(({"event_id": n} | r)[k] for k in names) for n, r in enumerate(rows)], EVENT_SCHEMA)

    return make


@pytest.fixture
def vocabulary():
    from pathloom.plans.vocabulary import StateDict

    return StateDict(("top/H", "top/C", "top/a", "top/b", "top/c", "top/d", "top/e", "top/f"), ("L",), ("L>(none)",), ("1.0", "2.0"))


@pytest.fixture
def cube(events, vocabulary):
    from pathloom.plans import cubes

    def build(name, *rows, days=(DAY,), vocabulary=vocabulary, **more):
        return cubes.build(name, events(*rows), list(days), vocabulary, **more)

    return build


def edges_of(df):
    return {(r["from_state"], r["to_state"]): r["cnt"] for r in df.groupBy("from_state", "to_state").agg({"cnt": "sum"}).withColumnRenamed("sum(cnt)", "cnt").collect()}


@pytest.fixture
def edges(spark):
    def make(*rows, columns="from_state string, to_state string, cnt long"):
        return spark.createDataFrame(list(rows), columns)

    return make
