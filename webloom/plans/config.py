"""Limits of a research request, read from JSON and brought into their ranges."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

QUALITIES = ("balanced", "aggressive", "high")


@dataclass(frozen=True)
class Research:
    query: str
    depth: int = 1
    max_sources: int = 10
    max_chars: int = 20_000
    max_concurrent: int = 3
    threshold: float | None = None
    quality: str = "balanced"

    @classmethod
    def of(cls, request: dict) -> Research:
        """Numbers are cut to their ranges; a blank query or an unknown quality is an error."""
        query = str(request.get("query") or "").strip()
        if not query:
            raise ValueError("query is blank")
        quality = str(request.get("quality_mode") or "balanced").lower()
        if quality not in QUALITIES:
            raise ValueError(f"quality_mode is none of {', '.join(QUALITIES)}")

        def whole(name: str, default: int, low: int, high: int) -> int:
            v = request.get(name)
            return min(high, max(low, v)) if isinstance(v, int) and not isinstance(v, bool) else default

        t = request.get("relevance_threshold")
        return cls(
            query,
            whole("depth", 1, 1, 3),
            whole("max_sources", 10, 1, 20),
            whole("max_chars_per_source", 20_000, 1, 1 << 31),
            whole("max_concurrent", 3, 1, 10),
            min(1.0, max(0.0, float(t))) if isinstance(t, int | float) and not isinstance(t, bool) else None,
            quality,
        )


def settings(*places: str) -> dict:
    """The first of the JSON files that is there; an unreadable one, or none, is no settings."""
    for place in places:
        if Path(place).is_file():
            try:
                return json.loads(Path(place).read_text())
            except ValueError:
                return {}
    return {}
