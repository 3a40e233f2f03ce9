"""Building cubes day by day, or many days at once, and loading them as a set."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.analyses.base import CubeSet
from pathloom.plans import cubes as K
from pathloom.plans import sessions as S
from pathloom.plans import vocabulary as V
from pathloom.sources import events as E
from pathloom.sources.store import CubeNotBuiltError, Store, key_of
from pathloom.storage import discard, stored

#: ``scan(days, services)`` gives canonical events of exactly these partitions.
Scan = Callable[[Sequence[str], Sequence[str]], DataFrame]


@dataclass(frozen=True)
class BuildReport:
    built: dict[str, list[str]]
    skipped: dict[str, list[str]]
    failed: str = ""


@dataclass(frozen=True)
class Builder:
    store: Store
    scan: Scan
    services: tuple[str, ...]
    source_version: str = ""
    top: int = K.PATH_TOP
    #: Days of one job; more days take several.
    days_at_once: int = 31

    def vocabulary(self, start: str, end: str, cut_ratio: float = V.CUT_RATIO, min_count: int = V.MIN_COUNT, exact: bool = True) -> V.StateDict:
        """Counted over the whole window once, kept by its version."""
        days = E.days_between(start, end)
        found = V.build(self.scan(days, self.services), cut_ratio, min_count, exact)
        self.store.save_vocabulary(found)
        return found

    def key(self, cube: str, vocabulary: V.StateDict) -> str:
        return key_of(cube, self.source_version, self.services, vocabulary, **({"top": self.top} if cube == "path" else {}))

    def build(self, start: str, end: str, vocabulary: V.StateDict, names: Sequence[str] = K.CUBES, refresh: bool = False) -> BuildReport:
        """Builds what is missing; stops at the first failure and says where, so a second call goes on from there."""
        return self.build_days(E.days_between(start, end), vocabulary, names, refresh)

    def build_days(self, days: Sequence[str], vocabulary: V.StateDict, names: Sequence[str] = K.CUBES, refresh: bool = False) -> BuildReport:
        """``build`` for any set of days, with gaps or without."""
        built: dict[str, list[str]] = {n: [] for n in names}
        skipped: dict[str, list[str]] = {n: [] for n in names}
        days = sorted(set(days))
        for at in range(0, len(days), self.days_at_once):
            part = days[at : at + self.days_at_once]
            missing = {n: [d for d in part if refresh or not self.store.has(n, self.key(n, vocabulary), d)] for n in names}
            for n in names:
                skipped[n] += [d for d in part if d not in missing[n]]
            todo = sorted({d for ds in missing.values() for d in ds})
            if not todo:
                continue
            events = self.scan(E.window_days(todo), self.services)
            rows = visits = None
            try:
                if sum(bool(missing[n]) for n in names if n != "quality") > 1:
                    # Five cubes from one pass: the marked events are written once.
                    rows = stored(S.marked(events, todo, vocabulary), "marked")
                    if sum(bool(missing[n]) for n in names if n in K.OF_VISITS) > 1:
                        visits = stored(S.visit_rows(rows), "visits")
                for n in names:
                    if not missing[n]:
                        continue
                    try:
                        cube = K.build(n, events, missing[n], vocabulary, rows, self.top, visits).where(F.col("date").isin(*missing[n]))
                        self.store.write(n, self.key(n, vocabulary), cube, missing[n])
                    except Exception as why:
                        return BuildReport(built, skipped, f"{n} {missing[n][0]}: {type(why).__name__}: {why}")
                    built[n] += missing[n]
            finally:
                discard(rows, visits)
        return BuildReport(built, skipped)

    def load(self, start: str, end: str, vocabulary: V.StateDict, names: Sequence[str] = K.CUBES) -> CubeSet:
        """The named cubes on the days that all of them have."""
        days = E.days_between(start, end)
        loaded = {n: self.store.read(n, self.key(n, vocabulary), days) for n in names}
        common = sorted(set.intersection(*(set(c.present) for c in loaded.values())))
        if not common:
            raise CubeNotBuiltError(f"the cubes {', '.join(names)} share no built day")
        frames = {n: c.frame.where(F.col("date").isin(*common)) for n, c in loaded.items()}
        return CubeSet(**frames, state_dict_version=vocabulary.version(), services=tuple(self.services), requested_dates=tuple(days), present_dates=tuple(common))
