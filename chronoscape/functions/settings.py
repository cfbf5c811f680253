"""Small settings on the driver, and the words that describe a detection."""

from __future__ import annotations

import json
from pathlib import Path


def load(path: str | Path) -> dict:
    """The saved settings, or none if they cannot be read."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def save(path: str | Path, **changes) -> bool:
    """Merge changes into the saved settings; False if they cannot be written."""
    try:
        Path(path).write_text(json.dumps(load(path) | changes, indent=2), encoding="utf-8")
    except OSError:
        return False
    return True


def describe(det) -> str:
    return f"Changes of at least {det.min_db:g} dB over at least {det.min_area_m2:,.0f} m², each pixel with a chance below 1 in {1 / det.alpha:,.0f} of being noise."
