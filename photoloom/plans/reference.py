"""All queries of the engine's own operators."""

from __future__ import annotations

from photoloom.plans import aggregates, calibration, joins, projections, series

PARTS = [projections, joins, aggregates, series, calibration]

QUERIES = {k: v for p in PARTS for k, v in p.query.QUERIES.items()}
ORACLES = {k: v for p in PARTS for k, v in p.query.ORACLES.items()}
