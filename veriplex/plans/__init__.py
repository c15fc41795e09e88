"""Registered queries and their SQL."""

from __future__ import annotations

from .authenticated import QUERIES as TREE_QUERIES
from .authenticated import SQL as TREE_SQL
from .logical import QUERIES as PLAIN_QUERIES
from .logical import SQL as PLAIN_SQL

QUERIES = PLAIN_QUERIES | TREE_QUERIES
ORACLE_SQL = PLAIN_SQL | TREE_SQL
