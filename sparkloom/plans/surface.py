"""All queries of the SQL surface and of the engine's operators, by name."""

from . import aggregates, filters, joins, knowledge, recursive, scalars, sets, windows  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
