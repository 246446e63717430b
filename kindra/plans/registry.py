"""Every registered query with the SQL that checks it."""

from __future__ import annotations

from kindra.plans import demo

QUERIES = dict(demo.QUERIES)
ORACLES = dict(demo.ORACLES)
