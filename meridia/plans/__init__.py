"""Every module here registers its queries on import."""

from . import aggregates, files, joins, more, ownership, planar, scalars, sets, shapes, shaping, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
