"""The registered queries: each Spark callable next to the SQL that must agree with it."""

from catalog.registry import QUERIES, SQL  # noqa: F401
