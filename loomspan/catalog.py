"""All queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib

from loomspan.plans.views import ORACLES, QUERIES

GROUPS = ("intervals", "sequences", "reads", "features", "comparative", "popgen", "alignments", "ontology", "variants", "records", "formats")


def _load() -> None:
    for name in GROUPS:
        importlib.import_module(f"loomspan.plans.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)
