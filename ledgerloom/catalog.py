"""All registered queries of the library and their SQL."""

from .plans import aggregates, joins, lookup, mail, questions, ranking, resolution, scalars, scoring, shaping, signals, sources, tables, windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
