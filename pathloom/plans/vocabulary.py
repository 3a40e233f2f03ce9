"""Vocabularies that are fixed before cubes are built.

Values are weighed by the sessions that hold them, taken from the most frequent
down to a share of the total (the value that crosses it included) and no rarer
than a least count.  Everything else folds to ``other`` in the cubes, so adding
days later moves no earlier day.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import columns as C

CUT_RATIO, MIN_COUNT, MOST_VERSIONS = 0.95, 10_000, 16
KINDS = ("screens", "layer1", "layer2", "versions")


class VocabularyMismatchError(ValueError):
    """A stored vocabulary is not the one its name says."""


@dataclass(frozen=True)
class StateDict:
    screens: tuple[str, ...]
    layer1: tuple[str, ...]
    layer2: tuple[str, ...]
    app_versions: tuple[str, ...]
    cut_ratio: float = CUT_RATIO
    min_count: int = MIN_COUNT

    def version(self) -> str:
        what = json.dumps([list(v) if isinstance(v, tuple) else v for v in asdict(self).values()], sort_keys=True, ensure_ascii=False)
        return "sd_" + hashlib.sha256(what.encode()).hexdigest()[:16]

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"version": self.version()}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str, version: str) -> StateDict:
        raw = json.loads(text)
        raw.pop("version", None)
        found = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
        if found.version() != version:
            raise VocabularyMismatchError(f"the vocabulary hashes to {found.version()}, not {version}")
        return found


def _value(kind: str):
    return {
        "screens": F.when(F.col("action_type") == "Pageview", C.screen_name(F.col("service_code"), F.col("action_name"))),
        "layer1": C.filled(F.col("layer1")), "layer2": C.slot(F.col("layer1"), F.col("layer2")), "versions": C.filled(F.col("raw_version")),
    }[kind]


def counts_by_kind(events: DataFrame, kinds: tuple[str, ...] = KINDS, exact: bool = True, rsd: float = 0.023) -> DataFrame:
    """kind, value and its number of sessions, for all kinds in one pass over the valid events."""
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), _value(k).alias("value")) for k in kinds]), lambda x: x["value"].isNotNull())
    rows = events.where("is_valid").select("uuid", "suid", F.explode(found).alias("x")).select("uuid", "suid", "x.kind", "x.value")
    n = F.count_distinct("uuid", "suid") if exact else F.approx_count_distinct(F.concat("uuid", F.lit("|"), "suid"), rsd)
    return rows.groupBy("kind", "value").agg(n.alias("cnt"))


def counts(events: DataFrame, kind: str, exact: bool = True, rsd: float = 0.023) -> DataFrame:
    """value and its number of sessions."""
    return counts_by_kind(events, (kind,), exact, rsd).drop("kind")


def cut(counted: DataFrame, cut_ratio: float = CUT_RATIO, min_count: int = MIN_COUNT, most: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """value, cnt, rank of the values kept, most frequent first (ties by value), within each of ``by``.

    A value is kept if the values before it hold less than ``cut_ratio`` of all
    sessions.  Values of one count stand together, so the running sum goes over the
    different counts, of which there are few; of the count at which it passes the
    ratio the first values are taken.  Ranks are given to what is kept.
    """
    keys = list(by)
    whole = Window.partitionBy(*(keys or [F.lit(1)]))
    levels = counted.groupBy(*keys, "cnt").agg(F.count(F.lit(1)).alias("n"))
    running = whole.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumns({"before": F.coalesce(F.sum(F.col("n") * F.col("cnt")).over(running), F.lit(0)), "aim": F.lit(cut_ratio) * F.sum(F.col("n") * F.col("cnt")).over(whole)})
    levels = levels.where((F.col("before") < F.col("aim")) & (F.col("cnt") >= min_count))
    near = counted.where(F.col("cnt") >= min_count).join(levels, [*keys, "cnt"])
    last = F.col("before") + (F.col("n") - 1) * F.col("cnt") >= F.col("aim")
    place = F.row_number().over(Window.partitionBy(*keys, "cnt").orderBy("value"))
    first = near.where(last).withColumn("place", place).where(F.col("before") + (F.col("place") - 1) * F.col("cnt") < F.col("aim")).drop("place")
    kept = near.where(~last).unionByName(first).withColumn("rank", F.row_number().over(whole.orderBy(F.desc("cnt"), "value"))).select(*keys, "value", "cnt", "rank")
    return kept.where(F.col("rank") <= most) if most else kept


def build(events: DataFrame, cut_ratio: float = CUT_RATIO, min_count: int = MIN_COUNT, exact: bool = True) -> StateDict:
    """All four vocabularies; what comes to the driver is what the cut has kept."""
    kept = cut(counts_by_kind(events, exact=exact), cut_ratio, min_count, by=("kind",))
    kept = kept.where((F.col("kind") != "versions") | (F.col("rank") <= MOST_VERSIONS))
    rows = sorted(kept.collect(), key=lambda r: (r["kind"], r["rank"]))
    of = {k: tuple(r["value"] for r in rows if r["kind"] == k) for k in KINDS}
    return StateDict(of["screens"], of["layer1"], of["layer2"], of["versions"], cut_ratio, min_count)
