"""The library's queries by name, and the SQL that says the same."""

from . import base, graph_queries, read_queries


def queries():
    return base.QUERIES


def oracles():
    return base.ORACLES
