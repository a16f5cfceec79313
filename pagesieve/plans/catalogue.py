"""Importing this module registers every query."""

from pagesieve.plans import json_queries, ledger_queries, link_queries, record_queries, spec_queries, trust_queries, url_queries, variant_queries  # noqa: F401
from pagesieve.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
