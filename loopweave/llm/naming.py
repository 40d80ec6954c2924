"""Names for binary files that tasks write."""

from __future__ import annotations

import uuid


def unique_name(prefix: str, suffix: str) -> str:
    """A file name no other attempt uses; only names that a task returns count."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"
