"""Registered queries, each operator on whole tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from winnow.plans.checks import boosted, cleaning, comparisons, encoding, importances, splitting

AREAS = (cleaning, splitting, encoding, importances, boosted, comparisons)


def all_queries() -> dict:
    return {name: run for area in AREAS for name, run in area.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for area in AREAS for name, sql in area.ORACLES.items()}


def flagship(spark, sf_dir: str):
    return all_queries()["metrics_of_encoding"](spark, sf_dir)
