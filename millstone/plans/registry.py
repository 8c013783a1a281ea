"""Registered queries: one Spark DataFrame builder and (where SQL can say
the same) one DuckDB oracle string per operator of the inventory.

Every query reads the supplied tables in full. Names follow the operator
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco
