"""Queries over the test tables; importing the package registers all of them."""

from quillon.plans import pipelines, queries, scale

__all__ = ["pipelines", "queries", "scale"]
