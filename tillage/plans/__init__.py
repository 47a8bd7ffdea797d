"""Queries over the parquet tables, each with its SQL; importing the package fills the registry."""

from tillage.plans import composites, filters, joins, reshapes, rollups, scalars, series, streams, writers  # noqa: F401
