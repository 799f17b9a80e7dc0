"""The registered queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from plumbline.plans import dimensions, gates, matching, postings, records, relational, reviews, rules, search, snapshots, states, temporal, texts, transitions  # noqa: F401  register their queries
from plumbline.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
