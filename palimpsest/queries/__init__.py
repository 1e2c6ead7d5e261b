"""Named queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from . import corpus, evidence, ledger, relational, repository, streams, workflow

_PARTS = (relational, corpus, repository, evidence, workflow, ledger, streams)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
