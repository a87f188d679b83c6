"""Registered queries and their SQL oracles."""

from suite import (  # noqa: F401
    catalogs, clause_rules, copy_rules, groundings, lifecycles, link_audits, query_sets, retrieval, searches, texts,
)
from suite.base import ORACLES, QUERIES  # noqa: F401
