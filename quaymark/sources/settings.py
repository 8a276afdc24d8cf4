"""Settings: environment over a JSON file over defaults, each cast to the kind of its default."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from typing import Any, TypeVar

T = TypeVar("T")


@dataclass(frozen=True)
class Recognition:
    """How images are cropped, results accepted and images routed.  Names and defaults are fixed values."""

    use_crop_service: bool = True
    max_crops_per_image: int = 8
    stop_on_first_valid: bool = True
    accept_non_iso_result: bool = False
    save_debug_on_not_found: bool = True
    enable_resize_digit_pass: bool = True
    enable_two_lines_hard_fallback: bool = False
    layout_twolines_max_ratio: float = 3.0
    layout_oneline_min_ratio: float = 3.0
    layout_split_door_min_height: int = 420


@dataclass(frozen=True)
class Service:
    """Where the service listens and with how many workers (1 to 16)."""

    host: str = "127.0.0.1"
    port: int = 8000
    workers: int = 1
    debug_visualization: bool = False


def cast_like(value: Any, default: T) -> T:
    """The value as the kind of the default; the default where that fails."""
    if isinstance(default, bool):
        if isinstance(value, str):
            return value.strip().lower() in ("1", "true", "yes", "on")
        return bool(value) if value is not None else default
    try:
        return type(default)(value)
    except (TypeError, ValueError):
        return default


def load(kind: type[T], text: str | None = None, env: dict[str, str] | None = None, prefix: str = "") -> T:
    """Defaults, overlaid by a JSON object (ignored if it is none), overlaid by `PREFIX_NAME` variables."""
    out = kind()
    try:
        stored = json.loads(text) if text else {}
    except ValueError:
        stored = {}
    stored = stored if isinstance(stored, dict) else {}
    for f in fields(out):
        default = getattr(out, f.name)
        if stored.get(f.name) is not None:
            out = replace(out, **{f.name: cast_like(stored[f.name], default)})
        key = f"{prefix}_{f.name}".upper().strip("_")
        if env and env.get(key):
            out = replace(out, **{f.name: cast_like(env[key], default)})
    if isinstance(out, Service):
        out = replace(out, workers=max(1, min(16, out.workers)))
    return out
