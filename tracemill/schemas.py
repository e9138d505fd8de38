"""Ranks of the event store's confidence."""

from __future__ import annotations

# The ranks by which overrides are compared.
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1, "missing": 0}
