"""Event sources: from a nested or flat log to canonical events.

Canonical columns: event_id, uuid, suid, ts, date_id, action_type, action_kind,
action_name, service_code, page, layer1, layer2, usage_duration_ms, raw_version,
service_type, os, daypart, gender, age_band, is_valid.

A source says by a mapping where each raw field stands, so another layout needs
another mapping and no other code.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions import columns as C

#: Places of the fields in a log of nested records.
NESTED = {
    "uuid": "user.uuid", "suid": "user.suid", "access_time": "common.access_time", "service_type": "common.service_type", "page": "common.page",
    "action_type": "action.type", "action_kind": "action.kind", "action_name": "action.name", "layer1": "click.layer1", "layer2": "click.layer2",
    "duration": "usage.duration", "os": "env.os", "app_version": "env.app_version", "daypart": "date.daypart", "is_invalid": "tag.is_invalid",
    "date_id": "date_id", "service_code": "c_service_code",
}


class UnboundedScanError(ValueError):
    """A scan without days or services would read the whole log."""


def days_between(start: str, end: str) -> list[str]:
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    if b < a:
        raise ValueError(f"the window ends ({end}) before it starts ({start})")
    return [(a + timedelta(days=k)).isoformat() for k in range((b - a).days + 1)]


def window_days(days: Sequence[str]) -> list[str]:
    """The days with one more before and after each: what a build of ``days`` has to read."""
    near = {date.fromisoformat(d) + timedelta(days=k) for d in days for k in (-1, 0, 1)}
    return [d.isoformat() for d in sorted(near)]


@dataclass(frozen=True)
class Source:
    """Where a table is, how its fields are called, and fixed conditions on it."""

    name: str
    path: str
    format: str = "parquet"
    fields: Mapping[str, str] = field(default_factory=lambda: dict(NESTED))
    filters: tuple[str, ...] = ()
    options: Mapping[str, str] = field(default_factory=dict)
    #: Environment variables that hold option values (user, password), read when the source is opened.
    secret_options: Mapping[str, str] = field(default_factory=dict)

    def version(self) -> str:
        """Changes with anything that changes what is read; secrets are no part of it."""
        what = [self.name, self.path, self.format, dict(self.fields), list(self.filters), dict(self.options)]
        return hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()[:16]

    def open(self, spark: SparkSession) -> DataFrame:
        secret = {k: os.environ[v] for k, v in self.secret_options.items()}
        reader = spark.read.format(self.format).options(**self.options, **secret)
        df = reader.load(self.path) if self.format != "jdbc" else reader.load()
        for f in self.filters:
            df = df.where(f)
        return df


def load_sources(path: str) -> dict[str, Source]:
    """Sources by name from a JSON list of their fields."""
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)
    return {r["name"]: Source(**(r | {"filters": tuple(r.get("filters", ()))})) for r in rows}


def scan(df: DataFrame, days: Sequence[str], services: Sequence[str], fields: Mapping[str, str] = NESTED) -> DataFrame:
    """The partitions of ``days`` and ``services``; both are asked for, so that no scan is unbounded."""
    if not days or not services:
        raise UnboundedScanError("a scan needs days and services")
    return df.where(F.col(fields["date_id"]).isin(*days) & F.col(fields["service_code"]).isin(*services))


def demography(dim: DataFrame) -> DataFrame:
    """uuid, gender, service_age_band with one row for each uuid."""
    return dim.groupBy("uuid").agg(F.max("gender").alias("gender"), F.max("service_age_band").alias("service_age_band"))


def canonical(raw: DataFrame, dim: DataFrame | None, fields: Mapping[str, str] = NESTED, event_id: Column | None = None) -> DataFrame:
    """Canonical events from raw ones.  ``event_id`` breaks ties of time; by default a hash of the row."""

    def at(name: str) -> Column:
        return F.col(fields[name])

    # A duration that is no number is unknown; so is a time that cannot be read.
    rows = raw.select(
        (event_id if event_id is not None else F.xxhash64(*[F.col(v) for v in fields.values()])).alias("event_id"),
        at("uuid").cast("string").alias("uuid"), at("suid").cast("string").alias("suid"),
        at("access_time").try_cast("timestamp_ntz").alias("ts"), at("date_id").cast("string").alias("date_id"),
        at("action_type").alias("action_type"), at("action_kind").alias("action_kind"), at("action_name").alias("action_name"),
        at("service_code").alias("service_code"), at("page").alias("page"), at("layer1").alias("layer1"), at("layer2").alias("layer2"),
        at("duration").try_cast("double").alias("usage_duration_ms"), at("app_version").alias("raw_version"),
        C.or_else(at("service_type"), C.UNKNOWN).alias("service_type"), C.os_family(at("os")).alias("os"), C.or_else(at("daypart"), C.UNKNOWN).alias("daypart"),
        (F.coalesce(at("is_invalid").cast("string"), F.lit("0")) == "1").alias("flagged"),
    ).where(C.filled(F.col("uuid")).isNotNull() & C.filled(F.col("suid")).isNotNull())
    return with_demography(rows, dim).withColumn("is_valid", ~F.col("flagged") & F.col("ts").isNotNull()).drop("flagged")


def with_demography(rows: DataFrame, dim: DataFrame | None) -> DataFrame:
    if dim is None:
        return rows.withColumns({"gender": F.lit(C.UNKNOWN), "age_band": F.lit(C.UNKNOWN)})
    d = demography(dim).select("uuid", F.col("gender").alias("_gender"), F.col("service_age_band").alias("_band"))
    joined = rows.join(d, "uuid", "left")
    return joined.withColumns({"gender": C.or_else(F.col("_gender"), C.UNKNOWN), "age_band": C.age_band(F.col("_band"))}).drop("_gender", "_band")


def valid(events: DataFrame) -> DataFrame:
    return events.where("is_valid")


# ---------------------------------------------------------------- flat activity log

GAP_HOURS = 12
FLAT_SERVICES = ("top", "media", "sports")
FLAT_FIRST, FLAT_LAST = "2024-01-01", "2024-01-30"


def flat_demography(customers: DataFrame) -> DataFrame:
    """uuid, gender, service_age_band from a customer table; a fifth of the customers is not known."""
    k = F.col("c_nationkey") % 3
    return customers.where(F.col("c_custkey") % 5 != 0).select(
        F.col("c_custkey").cast("string").alias("uuid"), F.when(k == 0, "M").when(k == 1, "F").otherwise("N").alias("gender"), ((F.col("c_nationkey") % 8) * 10).cast("int").alias("service_age_band")
    )


def flat_raw(events: DataFrame) -> DataFrame:
    """Raw fields, named as in NESTED's keys, from a flat log (event_id, ts, user_id, event_type, value, props).

    Sessions: a gap of more than twelve hours between a user's events starts a
    new one; they are numbered by user.
    """
    from pyspark.sql import Window

    mine = Window.partitionBy("uuid").orderBy("ts", "event_id")
    k, kind = F.col("k"), F.col("event_type")
    rows = events.select(
        "event_id", F.col("user_id").cast("string").alias("uuid"), "user_id", "ts", "event_type", "value", F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("int").alias("k")
    )
    before = F.lag("ts").over(mine)
    fresh = (before.isNull() | (F.col("ts") > before + F.expr(f"INTERVAL {GAP_HOURS} HOURS"))).cast("int")
    rows = rows.withColumn("fresh", fresh).withColumn("suid", F.sum("fresh").over(mine.rowsBetween(Window.unboundedPreceding, 0)).cast("string"))
    view, click, error = kind.isin("view", "purchase", "signup"), kind == "click", kind == "error"
    hour = F.hour("ts")
    part = F.floor(hour / 6).cast("int") * 6
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return rows.select(
        "event_id", "uuid", "suid", F.col("ts").alias("access_time"), F.date_format(F.col("ts") + F.expr("INTERVAL 10 MINUTES"), "yyyy-MM-dd").alias("date_id"),
        F.when(view, "Pageview").when(click, "Event").when(error & (k < 70), "Usage").otherwise("App").alias("action_type"),
        F.when(view, F.when(k % 10 != 0, "ViewPage")).when(click, F.when(k % 2 == 0, "ClickContent"))
        .when(k < 70, "UsagePage").when(k < 85, "AppExit").otherwise("AppLaunch").alias("action_kind"),
        F.when(view, F.when(k % 25 != 0, F.concat(F.lit("s"), (k % 6).cast("string")))).otherwise(kind).alias("action_name"),
        F.concat(F.lit("p"), (k % 4).cast("string")).alias("page"),
        F.when(k < 60, "top").when(k < 90, "media").otherwise("sports").alias("service_code"),
        F.when(click & (k % 4 != 0), F.concat(F.lit("L"), (k % 5).cast("string"))).alias("layer1"),
        F.when(click & (k % 4 != 0) & (k % 7 != 0), F.concat(F.lit("M"), (k % 3).cast("string"))).alias("layer2"),
        F.when(error & (k < 70), F.col("value") * 1000).alias("duration"),
        F.when(F.dayofmonth("ts") - 1 + F.col("user_id") % 10 >= 18, "2.0").otherwise("1.0").alias("app_version"),
        F.element_at(F.array(*[F.lit(x) for x in ("MA", "MW", "PW")]), (F.col("user_id") % 3 + 1).cast("int")).alias("service_type"),
        F.element_at(F.array(*[F.lit(x) for x in (*C.OS_FAMILIES, "other")]), (F.col("user_id") % 5 + 1).cast("int")).alias("os"),
        F.concat(two(part), F.lit("~"), two(part + 5)).alias("daypart"),
        F.when(k == 99, "1").otherwise("0").alias("is_invalid"),
    )


FLAT = {name: name for name in NESTED}


def flat_events(spark: SparkSession, folder: str, days: Sequence[str] | None = None, services: Sequence[str] = FLAT_SERVICES) -> DataFrame:
    """Canonical events of a folder with ``events`` and ``customer`` tables, for builds of ``days``."""
    days = list(days) if days is not None else days_between(FLAT_FIRST, FLAT_LAST)
    raw = flat_raw(spark.read.parquet(f"{folder}/events.parquet"))
    dim = flat_demography(spark.read.parquet(f"{folder}/customer.parquet"))
    return canonical(scan(raw, window_days(days), services, FLAT), dim, FLAT, F.col("event_id"))


EVENT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("uuid", "suid", "date_id", "action_type", "action_kind", "action_name", "service_code", "page", "layer1", "layer2", "raw_version", "service_type", "os", "daypart", "gender", "age_band")]
    + [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("usage_duration_ms", T.DoubleType()), T.StructField("is_valid", T.BooleanType())]
)
