"""Registered queries of the curation and evaluation operators."""

from __future__ import annotations

from strandmill.plans import cases, curation, evaluation, imports, probes, reporting, sidecars, texts, versions

PARTS = (curation, evaluation, reporting, cases, sidecars, texts, imports, probes, versions)


def flagship(spark, sf_dir):
    """Documents that stay after boilerplate rules and template caps."""
    return curation.template_cap(spark, sf_dir)


def queries():
    return {name: q for part in PARTS for name, q in part.REGISTRY.queries.items()}


def oracle_sql():
    return {name: s for part in PARTS for name, s in part.REGISTRY.sql.items()}
