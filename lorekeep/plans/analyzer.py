"""Checks of a plan before it runs, for sessions that ask for them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from .nodes import CreateTable, Insert, Select

#: Tables that exist without a declaration.
BUILT_IN = ("global", "meta")


class AnalysisError(ValueError):
    pass


def analyze(plan: list, declared: Mapping[str, int | None] = {}) -> list:  # noqa: B006
    """The plan with defaults filled in; raises AnalysisError.

    Tables must be declared before INSERT and SELECT; vectors must have the
    declared length; a nearest-neighbour query without an order is ordered by
    similarity, and an order by similarity needs such a query.
    """
    tables = dict.fromkeys(BUILT_IN) | dict(declared)
    out = []
    for s in plan:
        if isinstance(s, CreateTable):
            tables[s.table] = s.dim
        elif isinstance(s, (Insert, Select)):
            table = s.id.table if isinstance(s, Insert) else s.table
            if table not in tables:
                raise AnalysisError(f"table {table} is not declared")
            vector = s.embedding if isinstance(s, Insert) else s.knn and s.knn.query
            if vector is not None and tables[table] is not None and len(vector) != tables[table]:
                raise AnalysisError(f"table {table} has vectors of {tables[table]} components, not {len(vector)}")
            if isinstance(s, Select):
                if s.order == "similarity" and s.knn is None:
                    raise AnalysisError("an order by similarity needs a query vector")
                if s.knn is not None and s.order is None:
                    s = replace(s, order="similarity")
        out.append(s)
    return out
