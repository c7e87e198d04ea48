"""Named queries over the analytic tables, with the SQL that checks them."""

from . import catalog, history, parts, state, text, timed

_PARTS = (history, text, timed, state, catalog, parts)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: s for part in _PARTS for name, s in part.SQL.items()}
