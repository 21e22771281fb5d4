"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from vulnlake.plans import assembly, changes, evaluation, files, links, portfolios, retrieval, texts

_MODULES = (assembly, changes, evaluation, links, texts, portfolios, retrieval, files)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
