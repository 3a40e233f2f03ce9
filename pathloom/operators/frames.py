"""Reading cubes safely: roll-up rows, additive sums, segments."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import columns as C

NON_ADDITIVE = frozenset({"uv"})


class NonAdditiveMeasureError(ValueError):
    """Users of several rows cannot be summed: the same user may be in many."""


class AmbiguousRollupError(ValueError):
    """Several roll-up rows stand at one coordinate."""


def full_rows(cube: DataFrame, axes: Iterable[str] = C.AXES) -> DataFrame:
    """Rows with a value on every axis: nothing rolled up."""
    out = cube
    for a in axes:
        out = out.where(F.col(a).isNotNull())
    return out


def rollup_rows(cube: DataFrame, folded: Iterable[str], axes: Iterable[str] = C.AXES, check: bool = False) -> DataFrame:
    """Rows with exactly the ``folded`` axes rolled up."""
    axes, folded = list(axes), set(folded)
    if folded - set(axes):
        raise KeyError(f"no such axis: {sorted(folded - set(axes))}")
    out = cube
    for a in axes:
        out = out.where(F.col(a).isNull() if a in folded else F.col(a).isNotNull())
    if check:
        kept = [a for a in axes if a not in folded]
        twice = out.groupBy(*kept).count().where("count > 1") if kept else out.groupBy(F.lit(1)).count().where("count > 1")
        if twice.limit(1).count():
            raise AmbiguousRollupError("more than one roll-up row at a coordinate: several days were put together")
    return out


def segment(cube: DataFrame, where: Mapping[str, object], skip_unknown: bool = False) -> DataFrame:
    """Rows whose columns have the wanted value, or one of the wanted values."""
    out = cube
    for name, want in where.items():
        if name not in cube.columns:
            if skip_unknown:
                continue
            raise KeyError(f"no such column: {name!r}")
        wants = list(want) if isinstance(want, (list, tuple, set, frozenset)) else [want]
        out = out.where(F.col(name).isin(*wants))
    return out


def additive_sum(cube: DataFrame, keys: Iterable[str], measures: Iterable[str]) -> DataFrame:
    measures = list(measures)
    if NON_ADDITIVE & set(measures):
        raise NonAdditiveMeasureError(f"{sorted(NON_ADDITIVE & set(measures))} cannot be summed")
    return cube.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
