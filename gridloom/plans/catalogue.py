"""All queries of the library but those of the optional corpus subpackage."""

from . import aggregates, clusters, grids, joins, learning, reports, scalars, storage, textures, windows, workflows  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
