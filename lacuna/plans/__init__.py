"""Queries over the driver tables, and the SQL they are checked against."""

from lacuna.plans.registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    from lacuna.plans import catalog_queries, matrix_queries, ordered_queries, stream_queries, tree_queries  # noqa: F401

    return QUERIES
