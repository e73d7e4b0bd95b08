"""Configuration in layers: packaged, home, project, and a file that the environment names."""

from __future__ import annotations

from pathlib import Path
from typing import Any


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Maps are merged key by key; anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def layered(packaged: dict[str, Any], files: list[str | None], named: str | None = None) -> dict[str, Any]:
    """Later layers win. A file that does not exist is skipped, unless the environment ``named`` it."""
    import yaml

    if named and not Path(named).is_file():
        raise FileNotFoundError(named)
    out = packaged
    for f in [*files, named]:
        if f and Path(f).is_file():
            found = yaml.safe_load(Path(f).read_text(encoding="utf-8")) or {}
            if not isinstance(found, dict):
                raise ValueError(f"{f}: a layer is a mapping")
            out = merged(out, found)
    return out
