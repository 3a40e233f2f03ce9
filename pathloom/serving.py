"""A request for an analysis: its parameters, limits and answer as plain data."""

from __future__ import annotations

import inspect
import json
import math
import threading
from collections.abc import Callable, Hashable, Mapping, Sequence
from typing import Any
from urllib.parse import parse_qs, quote, urlencode

from pathloom.analyses import base
from pathloom.operators import segments
from pathloom.plans import cubes as K
from pathloom.plans.builder import Builder
from pathloom.plans.vocabulary import StateDict
from pathloom.sources import events as E
from pathloom.sources.results import as_table
from pathloom.storage import discard
from pathloom.functions import columns as C

WARN_DAYS, MOST_DAYS, CHART_ROWS = 31, 90, 20
#: Analyses that need the click and path cubes; the others need three cubes.
WIDE = frozenset({"click_distribution", "conditional_flow", "path_ranking", "markov_order_test", "markov_order_flow", "community_paths"})
CORE = ("session", "transition", "quality")


#: What is looked at together.
TABS = {
    "overview": ("session_trend",),
    "flow": ("screen_flow", "screen_dwell_rank", "screen_pair_affinity", "screen_transition", "hub_neighbors", "reachability", "screen_communities", "community_paths"),
    "action": ("click_distribution", "conditional_flow", "path_ranking", "markov_order_test", "markov_order_flow"),
    "service": ("cross_service_flow",),
    "quality": ("quality_report",),
}
FIRST = "session_trend"
#: Parameters that name a screen, and those with few values.
SCREENS = frozenset({"source", "target", "screen"})
#: Those that stand empty by default and must be named nevertheless.
NAMED = frozenset({("reachability", "source"), ("reachability", "target")})
CHOICES = {"n": (3, 4, 5), "order": (2, 3), "by": ("action_kind", "layer1", "layer2")}
COLOURS = ("#4e79a7", "#f28e2b", "#59a14f", "#e15759", "#b07aa1", "#76b7b2", "#edc948", "#ff9da7", "#9c755f", "#bab0ac")


class ByteCache:
    """Values by key while their bytes fit a budget; those used longest ago go first.

    The value just asked for stays even if it is larger than the budget.  A key's
    value is made once, however many ask for it at the same time, and others are
    served meanwhile.
    """

    def __init__(self, budget: int, size_of: Callable[[Any], int], gone: Callable[[Any], None] = lambda _: None):
        self.budget, self.size_of, self.gone = budget, size_of, gone
        self.used = 0
        self._sizes: dict[Hashable, int] = {}
        self._values: dict[Hashable, Any] = {}
        self._making: dict[Hashable, threading.Lock] = {}
        self._lock = threading.Lock()

    def _touched(self, key: Hashable) -> bool:
        with self._lock:
            if key not in self._values:
                return False
            self._values[key] = self._values.pop(key)
            return True

    def get(self, key: Hashable, make: Callable[[], Any]) -> Any:
        with self._lock:
            turn = self._making.setdefault(key, threading.Lock())
        with turn:
            if self._touched(key):
                return self._values[key]
            value = make()
            size, out = self.size_of(value), []
            with self._lock:
                self._values[key], self._sizes[key] = value, size
                self.used += size
                for old in list(self._values)[:-1]:
                    if self.used <= self.budget:
                        break
                    self.used -= self._sizes.pop(old)
                    out.append(self._values.pop(old))
                    self._making.pop(old, None)
        for old in out:
            self.gone(old)
        return value

    def __len__(self) -> int:
        return len(self._values)


class PeriodError(ValueError):
    """A period that is reversed or too long."""


def check_period(start: str, end: str) -> list[str]:
    """Warnings about the period; refuses those too long to answer."""
    days = E.days_between(start, end)
    if len(days) > MOST_DAYS:
        raise PeriodError(f"{len(days)} days are more than {MOST_DAYS}")
    return [f"{len(days)} days: this takes a while"] if len(days) > WARN_DAYS else []


def cubes_for(name: str) -> tuple[str, ...]:
    return K.CUBES if name in WIDE else CORE


def coerce(name: str, given: Mapping[str, str]) -> dict:
    """Text parameters as the analysis' own kinds; blanks are left out."""
    known = inspect.signature(base.get(name)).parameters
    out: dict[str, object] = {}
    for k, v in given.items():
        if k not in known or k in ("cubes", "keys"):
            raise ValueError(f"{name} has no parameter {k!r}")
        v = v.strip()
        if not v:
            continue
        kind, default = str(known[k].annotation), known[k].default
        if "Sequence" in kind:
            parts = [x.strip() for x in v.split(",") if x.strip()]
            out[k] = tuple(int(x) for x in parts) if k == "exit_within" else tuple(parts)
        elif kind.startswith("int") or isinstance(default, int):
            out[k] = int(v)
        elif kind.startswith("float"):
            out[k] = float(v)
        else:
            out[k] = v
    return out


def segment_of(given: Mapping[str, str | Sequence[str]]) -> dict:
    """Axis values to filter by; blank axes are no condition."""
    unknown = set(given) - set(C.AXES)
    if unknown:
        raise ValueError(f"no such axis: {', '.join(sorted(unknown))}")
    return {k: (list(v) if not isinstance(v, str) else v) for k, v in given.items() if v}


def plain(x):
    """JSON has no infinite and no missing numbers."""
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, Mapping):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def show(x: float) -> str:
    if math.isnan(x):
        return ""
    return "∞" if math.isinf(x) else f"{x:,.0f}" if float(x).is_integer() else f"{x:.4g}"


def _numeric(schema) -> list[str]:
    return [f.name for f in schema if f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double")]


def chart_of(viz: Mapping, schema, rows: list[dict]) -> dict | None:
    """A chart as plain data in the Vega-Lite form; a graph as its nodes and edges; None for a table."""
    kind, x = viz.get("kind", "table"), viz.get("x")
    names, numeric = [f.name for f in schema], _numeric(schema)
    axis = lambda c, t, **more: {"field": c, "type": t, "title": None} | more
    if kind == "graph":
        group = viz.get("group")
        nodes = [{"name": r[x], "group": r.get(group), "colour": COLOURS[int(r.get(group) or 0) % len(COLOURS)]} for r in rows]
        widest = max((w for _, _, w in viz.get("edges", ())), default=0) or 1
        return {"kind": "graph", "x": x, "nodes": nodes, "edges": [{"from": a, "to": b, "weight": w, "width": 1 + 4 * w / widest} for a, b, w in viz.get("edges", ())]}
    if kind == "bar" and x in names and (y := next((c for c in numeric if c != x), None)):
        data = [{x: r[x], y: r[y]} for r in rows[:CHART_ROWS]]
        return {"mark": {"type": "bar", "color": COLOURS[0]}, "data": {"values": data}, "encoding": {"x": axis(x, "nominal", sort="-y"), "y": axis(y, "quantitative"), "tooltip": [axis(x, "nominal"), axis(y, "quantitative")]}}
    if kind == "line" and x in names:
        # One line for each number: long rows of x, series, value.
        data = [{x: r[x], "series": c, "value": r[c]} for c in numeric if c != x for r in rows]
        along = axis(x, "quantitative" if x in numeric else "ordinal")
        return {"mark": {"type": "line", "point": True}, "data": {"values": data}, "encoding": {"x": along, "y": axis("value", "quantitative"), "color": axis("series", "nominal", scale={"range": list(COLOURS)}), "tooltip": [along, axis("series", "nominal"), axis("value", "quantitative")]}}
    if kind == "heatmap" and x in names:
        to = next((c for c in ("to_state", "to_service") if c in names), None)
        value = viz.get("value", "cnt")
        if to and value in names:
            data = [{c: r[c] for c in (x, to, value)} for r in rows]
            return {"mark": "rect", "data": {"values": data}, "encoding": {"x": axis(x, "nominal"), "y": axis(to, "nominal"), "color": axis(value, "quantitative", scale={"scheme": "blues"}), "tooltip": [axis(x, "nominal"), axis(to, "nominal"), axis(value, "quantitative")]}}
    return None


def _answer(builder: Builder, vocabulary: StateDict, name: str, start: str, end: str, segment: Mapping, given: Mapping) -> tuple:
    cubes = builder.load(start, end, vocabulary, cubes_for(name)).filter(**segment)
    r = base.run(name, cubes, **given)
    return r, as_table(r.frame)


def answers(budget: int = 1 << 30) -> ByteCache:
    """A cache of answered requests; tables of those that go are deleted."""
    return ByteCache(budget, lambda a: a[1].bytes, lambda a: discard(a[1].frame))


def analyse(
    builder: Builder, vocabulary: StateDict, name: str, start: str, end: str, segment: Mapping | None = None, params: Mapping[str, str] | None = None, page: int = 1, page_size: int = 100,
    cache: ByteCache | None = None,
) -> dict:
    """The answer to a request: a page of rows, how many there are, the chart, headline and envelope.

    With a ``cache``, other pages of the same request are read from its rows.
    """
    notes = check_period(start, end)
    of, given = segment_of(segment or {}), coerce(name, params or {})
    key = (vocabulary.version(), name, start, end, json.dumps([of, given], sort_keys=True, default=str))
    make = lambda: _answer(builder, vocabulary, name, start, end, of, given)
    r, table = cache.get(key, make) if cache is not None else make()
    rows = table.page(page, page_size)
    kind = r.viz.get("kind")
    shown = [] if kind in (None, "table") else table.page(1, CHART_ROWS) if kind == "bar" else table.page(size=None)
    out = plain({
        "name": name, "rows": rows, "total_rows": table.total, "columns": [f.name for f in r.frame.schema], "chart": chart_of(r.viz, r.frame.schema, shown), "viz": dict(r.viz), "headline": r.headline,
        "headline_text": {k: t for k, v in r.headline.items() if (t := show(v))}, "envelope": r.envelope, "params": dict(r.params), "notes": notes,
    })
    if cache is None:
        discard(table.frame)
    return out


def compare(builder: Builder, vocabulary: StateDict, name: str, start: str, end: str, on: str, a: str, b: str, released: Mapping[str, str] | None = None, params: Mapping[str, str] | None = None) -> dict:
    check_period(start, end)
    cubes = builder.load(start, end, vocabulary, cubes_for(name))
    c = segments.compare(cubes, name, on, a, b, released if on == "app_version" else None, **coerce(name, params or {}))
    return plain({
        "name": name, "on": on, "a": a, "b": b, "pooled": c.pooled, "per_day": c.per_day.to_dict("records"), "weight_skew": c.weight_skew, "dates_used": c.dates_used,
        "date_reason": c.date_reason, "sign_disagrees": c.sign_disagrees, "envelope": c.envelope,
    })


def parameter_specs(name: str) -> list[dict]:
    """Name, kind, whether it must be given, default and choices of each parameter of an analysis."""
    out = []
    for k, p in inspect.signature(base.get(name)).parameters.items():
        if k in ("cubes", "keys"):
            continue
        kind, required = str(p.annotation), p.default is inspect.Parameter.empty or (name, k) in NAMED
        many = "Sequence" in kind
        word = "screen" if k in SCREENS else "int" if "int" in kind else "float" if "float" in kind else "str"
        out.append({"name": k, "kind": f"list of {word}" if many else word, "required": required, "default": None if required else base.canonical(p.default), "choices": list(CHOICES.get(k, ()))})
    return out


def meta(builder: Builder, vocabulary: StateDict, start: str, end: str) -> dict:
    """What can be asked: analyses by tab with their parameters, axis values, days, services and screens that are there."""
    cubes = builder.load(start, end, vocabulary, CORE)
    from pyspark.sql import functions as F

    values = cubes.session.agg(*[F.sort_array(F.collect_set(a)).alias(a) for a in C.AXES[1:]]).first().asDict()
    return plain({
        "tabs": [{"key": k, "analyses": list(v)} for k, v in TABS.items()], "analyses": {n: parameter_specs(n) for n in base.names()}, "axes": values, "days": list(cubes.present_dates),
        "services": list(builder.services), "screens": list(vocabulary.screens), "defaults": {"analysis": FIRST, "state_dict_version": vocabulary.version()},
    })


def asked_of(query: str) -> dict[str, str]:
    """A query string as a request: of a repeated key the last value, of a repeated axis all of them, by commas."""
    return {k: ",".join(v) if k in C.AXES else v[-1] for k, v in parse_qs(query).items()}


def link(name: str, start: str, end: str, segment: Mapping[str, str | Sequence[str]] | None = None, params: Mapping[str, str] | None = None, page: int = 1, between: tuple[str, str, str] | None = None) -> str:
    """Path and query string to which ``application`` gives this answer, for sharing.

    ``between`` (axis, a, b) asks for a comparison, which has no filter and no
    pages.  Blank values and the first page are left out.
    """
    own = {"start": start, "end": end} | {k: v for k, v in (params or {}).items() if str(v) != ""}
    if between:
        own |= dict(zip(("on", "a", "b"), between, strict=True))
    else:
        own |= segment_of(segment or {}) | ({"page": page} if page > 1 else {})
    return f"/api/{'compare' if between else 'analysis'}/{quote(name)}?{urlencode(own, doseq=True)}"


def application(builder: Builder, vocabulary: StateDict, start: str, end: str, budget: int = 1 << 30) -> Callable:
    """A WSGI application: /api/meta, /api/analysis/<name> and /api/compare/<name>, all with JSON answers.

    Of the query string, start, end, page, page_size, and for a comparison on, a
    and b, are the request's own; axes filter, several values by commas or by
    repeating the axis; the rest are the analysis' parameters.
    """
    cache = answers(budget)

    def answer(path: str, asked: dict[str, str]) -> dict:
        if path == "/api/meta":
            return meta(builder, vocabulary, asked.get("start", start), asked.get("end", end))
        what, _, name = path.removeprefix("/api/").partition("/")
        if not path.startswith("/api/") or what not in ("analysis", "compare") or not name:
            raise base.UnknownAnalysisError(f"nothing at {path}")
        base.get(name)
        period = asked.pop("start", start), asked.pop("end", end)
        if what == "compare":
            absent = [k for k in ("on", "a", "b") if not asked.get(k)]
            if absent:
                raise ValueError(f"a comparison needs {', '.join(absent)}")
            return compare(builder, vocabulary, name, *period, asked.pop("on"), asked.pop("a"), asked.pop("b"), params=asked)
        page, size = int(asked.pop("page", 1)), int(asked.pop("page_size", 100))
        if page < 1 or not 1 <= size <= 10_000:
            raise ValueError("pages begin with 1 and have 1 to 10000 rows")
        segment = {k: asked.pop(k).split(",") for k in list(asked) if k in C.AXES and asked[k]}
        return analyse(builder, vocabulary, name, *period, segment, {k: v for k, v in asked.items() if k not in C.AXES}, page, size, cache)

    def app(environ: Mapping, start_response: Callable) -> list[bytes]:
        status, said = 200, {}
        try:
            if environ.get("REQUEST_METHOD", "GET") != "GET":
                status, said = 405, {"error": "only GET is served"}
            else:
                said = answer(environ.get("PATH_INFO", "/"), asked_of(environ.get("QUERY_STRING", "")))
        except Exception as why:
            status, said = status_of(why), {"error": f"{type(why).__name__}: {why}"}
        body = json.dumps(said, default=str).encode()
        names = {200: "OK", 400: "Bad Request", 404: "Not Found", 405: "Method Not Allowed", 500: "Internal Server Error"}
        start_response(f"{status} {names[status]}", [("Content-Type", "application/json"), ("Content-Length", str(len(body)))])
        return [body]

    return app


def status_of(error: Exception) -> int:
    """HTTP status of an error: unknown names are not found, bad values are bad requests."""
    return 404 if isinstance(error, base.UnknownAnalysisError) else 400 if isinstance(error, (ValueError, KeyError, LookupError)) else 500
