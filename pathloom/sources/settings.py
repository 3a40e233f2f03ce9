"""Calendars, releases and limits from JSON files, and the limits that hold without one."""

from __future__ import annotations

import json
from dataclasses import dataclass

# The limit of each check on its share of violations by service and day.
# screen_other_ratio has none: it cannot see names that a vocabulary folds.
QUALITY_LIMITS = {
    "session_no_screen": 0.15,
    "exit_without_appexit": 0.15,
    "screen_without_dwell": 0.50,
    "null_action_name": 0.25,
    "pageview_null_kind": 0.10,
    "session_span_exceeds_timeout": 0.01,
    "page_name_ambiguous": 0.10,
}


@dataclass(frozen=True)
class Holidays:
    names: dict[str, str]
    #: Windows in which the list is known to be whole.
    verified: tuple[tuple[str, str], ...] = ()

    @property
    def days(self) -> set[str]:
        return set(self.names)


def _json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def load_holidays(path: str) -> Holidays:
    raw = _json(path)
    return Holidays(dict(raw.get("holidays", {})), tuple((a, b) for a, b in raw.get("verified_windows", ())))


def load_limits(path: str) -> dict[str, float]:
    """Check name to limit; a limit has to say what it rests on."""
    out = {}
    for name, entry in _json(path).get("thresholds", {}).items():
        if not entry.get("basis"):
            raise ValueError(f"the limit of {name!r} has no basis")
        out[name] = float(entry["limit"])
    return out


def load_releases(path: str, os: str | None = None) -> dict[str, str]:
    """Version to its release day on ``os``; without one, the day from which it is out on both mobile platforms."""
    out = {}
    for version, days in _json(path).get("app_versions", {}).items():
        known = [days[k] for k in ((os,) if os else ("android", "ios")) if days.get(k)]
        if known:
            out[version] = max(known)
    return out
