"""Checks of a job's arguments before anything runs."""

from __future__ import annotations

import re

#: Rows that one contribution may have.
MOST_ROWS = 200_000


def rows_asked(n: int) -> int:
    """``n`` if a job may make so many rows, else an error."""
    if not 1 <= n <= MOST_ROWS:
        raise ValueError(f"rows must be 1 to {MOST_ROWS}, not {n}")
    return n


def handle(name: str) -> str:
    """A contributor's name as it may stand in a path: letters, digits, hyphens and underscores; an error if nothing is left."""
    kept = re.sub(r"[^\w\-]", "", name).strip()
    if not kept:
        raise ValueError("a contributor's name needs a letter or digit")
    return kept
