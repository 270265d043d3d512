"""Queries over the driver's tables, by group; importing this registers them all."""

from galena.queries import flows, ingestion, knowledge, more, processes, relational, search, texts  # noqa: F401
