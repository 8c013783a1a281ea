"""Imports every query module so the registry is complete."""

from __future__ import annotations

from millstone.plans import q_bpe, q_mix, q_order, q_stream, q_text  # noqa: F401
from millstone.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
