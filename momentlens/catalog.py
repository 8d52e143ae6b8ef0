"""All registered queries with the SQL they must agree with."""

from __future__ import annotations

from momentlens.plans import queries as plans
from momentlens.plans import models, segments  # noqa: F401  register their queries with the others


def queries():
    return plans.QUERIES


def oracle_sql():
    return plans.SQL


def flagship(spark, sf_dir):
    """Top integrated highlights of each recording."""
    return plans.t2_editor_table(spark, sf_dir)
