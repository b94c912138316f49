"""Queries over the given tables, one or more per operator, each with its SQL counterpart where there is one."""

from urlshift.workloads import columns, detecting, dumping, mapping, migrating, networking, replacing, revising, sourcing
from urlshift.workloads.registry import ORACLE, QUERIES

__all__ = [
    "ORACLE", "QUERIES", "columns", "detecting", "dumping", "mapping", "migrating", "networking", "replacing",
    "revising", "sourcing",
]
