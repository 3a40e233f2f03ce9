"""Where cubes and vocabularies are kept, and what is there.

A cube lies under ``<root>/cubes/<name>/<key>/date=<day>``; the key is a hash of
everything that defines its content, so another definition never meets old
files.  Days are written by dynamic partition overwrite: writing a day again
replaces that day and no other, and a day that has no rows any more is emptied.  The
columns are kept beside the rows, so that loading reads the folders of the days
asked for and no others.  All access goes through Spark's file systems,
so the root may be any storage that Spark reaches.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pathloom.functions import columns as C
from pathloom.plans.cubes import CUBES, SCHEMAS
from pathloom.plans.vocabulary import StateDict

#: Raise when a cube's definition changes: old files are then another cube's.
LOGIC_VERSION = 1


class CubeNotBuiltError(LookupError):
    """None of the days asked for has been built."""


class IncompleteCubeError(LookupError):
    """Some of the days asked for have not been built."""


class SchemaMismatchError(ValueError):
    """A stored file has other columns than its cube."""


def check_day(day: str) -> str:
    """A day is part of a path: nothing but YYYY-MM-DD gets there."""
    if not re.fullmatch(C.DAY_PATTERN, day):
        raise ValueError(f"not a day: {day!r}")
    return day


def key_of(cube: str, source_version: str, services: Sequence[str], vocabulary: StateDict | None, **more: object) -> str:
    """Hash of the logical definition: builder version, schema, source, services, vocabulary, parameters."""
    what = [LOGIC_VERSION, cube, SCHEMAS[cube], source_version, sorted(services), vocabulary.version() if vocabulary and cube != "quality" else None, sorted(more.items())]
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class LoadedCube:
    frame: DataFrame
    requested: tuple[str, ...]
    present: tuple[str, ...]
    missing: tuple[str, ...]

    def require_complete(self) -> DataFrame:
        if self.missing:
            raise IncompleteCubeError(f"not built: {', '.join(self.missing)}")
        return self.frame


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._path(path)
        return fs.exists(p)

    def folder(self, cube: str, key: str) -> str:
        if cube not in CUBES or not re.fullmatch(r"[0-9a-z_]+", key):
            raise ValueError(f"no such cube: {cube}/{key}")
        return f"{self.root}/cubes/{cube}/{key}"

    # ------------------------------------------------------------ cubes

    def has(self, cube: str, key: str, day: str) -> bool:
        return self.exists(f"{self.folder(cube, key)}/_days/{check_day(day)}")

    def write(self, cube: str, key: str, df: DataFrame, days: Sequence[str]) -> None:
        """All rows of ``days``; a day without rows counts as built too."""
        folder = self.folder(cube, key)
        at = {d: f"{folder}/rows/date={check_day(d)}" for d in days}
        self._check_columns(cube, df.schema, "new")
        before = {d: self.list_names(path) for d, path in at.items()}
        # One file for each day: a day's cube is small.
        df.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{folder}/rows")
        for d, path in at.items():
            # Files of another write stay where this one had no rows: the day is empty now.
            if before[d] and self.list_names(path) == before[d]:
                fs, p = self._path(path)
                fs.delete(p, True)
        self.write_text(f"{folder}/_columns.json", df.drop("date").schema.json())
        for d in days:
            fs, p = self._path(f"{folder}/_days/{d}")
            fs.create(p, True).close()

    def schema(self, cube: str) -> T.StructType:
        return T._parse_datatype_string(SCHEMAS[cube])

    def _check_columns(self, cube: str, found: T.StructType, which: str) -> None:
        have, want = ({(f.name, f.dataType.simpleString()) for f in x if f.name != "date"} for x in (found, self.schema(cube)))
        if have != want:
            raise SchemaMismatchError(f"{cube}: {which} columns differ from the cube's: {sorted(have)}")

    def read(self, cube: str, key: str, days: Iterable[str]) -> LoadedCube:
        requested = tuple(sorted({check_day(d) for d in days}))
        folder = self.folder(cube, key)
        built = set(self.list_names(f"{folder}/_days"))
        present = tuple(d for d in requested if d in built)
        if not present:
            raise CubeNotBuiltError(f"{cube}: none of {len(requested)} days is built")
        want, rows = self.schema(cube), f"{folder}/rows"
        missing = tuple(d for d in requested if d not in built)
        self._check_columns(cube, T.StructType.fromJson(json.loads(self.read_text(f"{folder}/_columns.json"))), "stored")
        there = set(self.list_names(rows))
        paths = [f"{rows}/date={d}" for d in present if f"date={d}" in there]
        if not paths:
            return LoadedCube(self.spark.createDataFrame([], want), requested, present, missing)
        return LoadedCube(self.spark.read.schema(want).option("basePath", rows).parquet(*paths), requested, present, missing)

    # ------------------------------------------------------------ vocabularies

    def save_vocabulary(self, v: StateDict) -> str:
        self.write_text(f"{self.root}/vocabularies/{v.version()}.json", v.to_json())
        return v.version()

    def load_vocabulary(self, version: str) -> StateDict:
        if not re.fullmatch(r"sd_[0-9a-f]{16}", version):
            raise ValueError(f"no vocabulary version: {version!r}")
        return StateDict.from_json(self.read_text(f"{self.root}/vocabularies/{version}.json"), version)

    # ------------------------------------------------------------ small files

    def write_text(self, path: str, text: str) -> None:
        fs, p = self._path(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def read_text(self, path: str) -> str:
        fs, p = self._path(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def list_names(self, path: str) -> list[str]:
        fs, p = self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
