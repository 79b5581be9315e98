"""Experiment settings: defaults, overlaid by a file, overlaid by what was typed; checks; retention policy."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from typing import Any, TypeVar

S = TypeVar("S")


def overlay(defaults: S, *layers: Mapping[str, Any]) -> S:
    """A dataclass with each layer's values put on top; unknown keys are an error."""
    known = {f.name for f in dataclasses.fields(defaults)}
    for layer in layers:
        unknown = sorted(set(layer) - known)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        defaults = dataclasses.replace(defaults, **layer)
    return defaults


def load_mapping(text: str) -> dict[str, Any]:
    """A settings file: JSON, or the part of YAML that settings are written in (:func:`read_yaml`); empty gives no settings."""
    if not text.strip():
        return {}
    import json

    found = json.loads(text) if text.lstrip().startswith("{") else read_yaml(text)
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError("settings must be a mapping")
    return found


def _scalar(text: str) -> Any:
    """A plain or quoted value, or a list of them in brackets."""
    import json

    text = text.strip()
    if text.startswith('"') and text.endswith('"') and len(text) > 1:
        return json.loads(text)
    if text.startswith("'") and text.endswith("'") and len(text) > 1:
        return text[1:-1].replace("''", "'")
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text.lower() in ("", "~", "null"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text.replace("_", ""))
        except ValueError:
            pass
    return text


def read_yaml(text: str) -> Any:
    """Nested mappings and lists by indentation, scalars, comments: no anchors, tags or blocks of text."""
    lines = []
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if bare.strip() and bare.strip() != "---":
            lines.append((len(bare) - len(bare.lstrip()), bare.strip()))

    def block(at: int, depth: int) -> tuple[Any, int]:
        out: Any = [] if lines[at][1].startswith("- ") or lines[at][1] == "-" else {}
        while at < len(lines) and lines[at][0] == depth:
            body = lines[at][1]
            if isinstance(out, list):
                if not body.startswith("-"):
                    raise ValueError(f"a list entry is expected: {body}")
                out.append(_scalar(body[1:]))
                at += 1
                continue
            name, found, value = body.partition(":")
            if not found:
                raise ValueError(f"a name and a colon are expected: {body}")
            at += 1
            if not value.strip() and at < len(lines) and lines[at][0] > depth:
                out[_scalar(name)], at = block(at, lines[at][0])
            else:
                out[_scalar(name)] = _scalar(value)
        if at < len(lines) and lines[at][0] > depth:
            raise ValueError(f"unexpected indentation: {lines[at][1]}")
        return out, at

    if not lines:
        return {}
    found, at = block(0, lines[0][0])
    if at < len(lines):
        raise ValueError(f"unexpected indentation: {lines[at][1]}")
    return found


def check_ranges(settings: Any, rules: Mapping[str, tuple[float | None, float | None]]) -> None:
    """Each named setting within its bounds (None: open); the first outside raises."""
    for name, (low, high) in rules.items():
        v = getattr(settings, name)
        if v is not None and ((low is not None and v < low) or (high is not None and v > high)):
            raise ValueError(f"{name} must be within {low}..{high}, got {v}")


def keep_policy(validates: bool, best_n: int) -> int:
    """Periodic checkpoints to keep."""
    return 1 if validates else best_n + 1


def shard_strategy(named: str, map_style: bool) -> str:
    return ("contiguous" if map_style else "dataset") if named == "auto" else named
