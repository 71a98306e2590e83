"""The registered queries of the colour engine and their SQL."""

from __future__ import annotations

from . import anchors, catalogue, colour, details, inputs, ranking, reports, texts  # noqa: F401
from .base import QUERIES, SQL

FLAGSHIP = "sco11_score"


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
