"""The registered catalog queries and their SQL, by subject."""

from . import lifecycle, matching, scalars, search, upkeep

_ALL = (search, scalars, upkeep, matching, lifecycle)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _ALL for k, v in m.ORACLE_SQL.items()}
