"""Registered queries: each applies an operator to the given tables, beside SQL that gives the same rows."""

from mosaique.queries import batch, jobs, pixels, similar, timelines  # noqa: F401
