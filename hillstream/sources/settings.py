"""Settings of a run: a YAML file as plain dicts, read on the driver."""

from __future__ import annotations

from pathlib import Path
from typing import Any

import yaml

#: Paths in these places are relative to the file.
ASSET_KEYS = (("scoreboard", "header_template_path"), ("hardpoint", "digit_templates_dir"))


def seconds(value: Any) -> float:
    """192, "192" or "3:12" as seconds; blank is 0, nothing is below 0."""
    if value is None or isinstance(value, str) and not value.strip():
        return 0.0
    if isinstance(value, str) and ":" in value:
        minutes, rest = value.strip().split(":")
        return max(0.0, 60.0 * int(minutes) + float(rest))
    return max(0.0, float(value))


def load(path: str | Path) -> dict[str, dict]:
    """The file's sections; asset paths are resolved against its folder."""
    path = Path(path)
    data = yaml.safe_load(path.read_text()) or {}
    for section, key in ASSET_KEYS:
        if (data.get(section) or {}).get(key):
            data[section][key] = str((path.parent / data[section][key]).resolve())
    return data


def section(data: dict, name: str) -> dict:
    """A copy of one section; capture gets start_time_seconds from start_time, else from the number."""
    out = dict(data.get(name) or {})
    if name == "capture":
        out["start_time_seconds"] = seconds(out["start_time"] if out.get("start_time") is not None else out.get("start_time_seconds"))
    return out
