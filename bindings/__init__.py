"""Operators bound to the test tables, each with an independent SQL form where SQL can express it."""
from __future__ import annotations

from .registry import ORACLE, QUERIES  # noqa: F401
from . import catalog, curate, feedback, groups, misc, pairs, scalars, streams, times  # noqa: F401,E402
