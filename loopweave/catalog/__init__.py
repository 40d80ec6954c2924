"""All registered queries and their SQL counterparts."""

import importlib

from loopweave.catalog.registry import ORACLES, QUERIES

SECTIONS = ["scalars", "aggregates", "joins", "windows", "quality", "reading", "writing",
            "reshaping", "learning", "questions", "feeds", "loading"]

for _section in SECTIONS:
    importlib.import_module(f"loopweave.catalog.{_section}")

__all__ = ["ORACLES", "QUERIES"]
