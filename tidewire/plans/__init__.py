"""Queries over the driver's tables, by area."""

from . import events, families, health, histories, quality, reports, scalars  # noqa: F401
