"""The registry of named queries; each plan module adds to it."""

from __future__ import annotations

from foretide.plans import backtest, domain, entities, records, relational, scalars, streams, textual

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (backtest, relational, textual, scalars, records, entities, streams, domain):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
