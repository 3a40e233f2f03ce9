"""Published results, cached aggregates and registries: small records beside tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.analyses.base import ENVELOPE_KEYS, AnalysisResult, canonical
from pathloom.sources.store import Store
from pathloom.storage import stored


class IncompleteEnvelopeError(ValueError):
    """A result without its envelope would be read as whole."""


class ConflictingPublicationError(ValueError):
    """A title already stands for a result with other parameters."""


def result_id(run_id: str, kind: str, title: str) -> str:
    return hashlib.sha256(json.dumps([run_id, kind, title]).encode()).hexdigest()[:16]


def caveats(envelope: Mapping) -> str:
    """What a reader has to know, in a line."""
    parts = [f"services {', '.join(envelope['services']) or '(none)'}"]
    if not envelope["is_complete"]:
        parts.append(f"{len(envelope['missing_dates'])} days not built")
    parts += [f"{k} coverage {v:.1%}" for k, v in sorted(envelope["coverage"].items())]
    if envelope["warnings"]:
        parts.append(f"{len(envelope['warnings'])} warnings")
    return "; ".join(parts)


def publish(store: Store, result: AnalysisResult, run_id: str, kind: str, title: str, insight: str | None = None) -> str:
    """Frame as a table, everything else as a record; the same call again replaces itself."""
    missing = [k for k in ENVELOPE_KEYS if k not in result.envelope]
    if missing:
        raise IncompleteEnvelopeError(f"the envelope lacks {', '.join(missing)}")
    key = result_id(run_id, kind, title)
    record = f"{store.root}/results/{key}.json"
    params = canonical(result.params)
    if store.exists(record):
        before = json.loads(store.read_text(record))["params"]
        if before != params:
            differ = sorted(k for k in {*before, *params} if before.get(k) != params.get(k))
            raise ConflictingPublicationError(f"{title!r} is published with another {', '.join(differ)}")
    result.frame.write.mode("overwrite").parquet(f"{store.root}/results/{key}.parquet")
    store.write_text(record, json.dumps({
        "id": key, "run_id": run_id, "analysis": kind, "title": title, "insight": insight, "params": params, "headline": result.headline, "envelope": result.envelope,
        "viz": dict(result.viz), "caveats": caveats(result.envelope),
    }, default=str))
    return key


def list_results(store: Store, run_id: str | None = None) -> list[dict]:
    found = [json.loads(store.read_text(f"{store.root}/results/{n}")) for n in store.list_names(f"{store.root}/results") if n.endswith(".json")]
    return [r for r in found if run_id is None or r["run_id"] == run_id]


def read_result(store: Store, key: str) -> tuple[dict, DataFrame]:
    record = json.loads(store.read_text(f"{store.root}/results/{key}.json"))
    return record, store.spark.read.parquet(f"{store.root}/results/{key}.parquet")


def cached(store: Store, what: str, version: str, make: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """A table made once for each definition and source version; a failed write leaves nothing behind."""
    key = hashlib.sha256(json.dumps([what, version]).encode()).hexdigest()[:16]
    path = f"{store.root}/cache/{key}"
    if refresh or not store.exists(f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return store.spark.read.parquet(path)


def register_skill(store: Store, name: str, record: Mapping) -> dict:
    """Adds or replaces a named record."""
    path = f"{store.root}/skills.json"
    have = json.loads(store.read_text(path)) if store.exists(path) else {}
    have[name] = dict(record)
    store.write_text(path, json.dumps(have, sort_keys=True))
    return have


@dataclass(frozen=True)
class Table:
    """Rows of a result, computed once and numbered in their order."""

    frame: DataFrame
    total: int
    bytes: int

    def page(self, page: int = 1, size: int | None = 100) -> list[dict]:
        """Rows of a page, all with ``size`` None; what is not a finite number is null."""
        clean = [F.when(F.col(f.name).isin(float("inf"), float("-inf")) | F.isnan(f.name), None).otherwise(F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in self.frame.schema if f.name != PLACE]
        rows = self.frame.orderBy(PLACE).select(*clean)
        if size is not None:
            rows = rows.offset((max(1, page) - 1) * size).limit(size)
        return [r.asDict() for r in rows.collect()]


#: Numbers that ascend in the order of the rows.
PLACE = "_place"


def as_table(frame: DataFrame) -> Table:
    kept = stored(frame.withColumn(PLACE, F.monotonically_increasing_id()), "result")
    path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(kept.stored_at)
    size = path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return Table(kept, kept.count(), size)
