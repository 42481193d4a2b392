"""All registered queries on the reference's operators."""

from __future__ import annotations

from . import assessment, chart, comparisons, episodes, evaluation, graphs, notes, records, relational, resolution, texts, timelines, traces, visits  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
