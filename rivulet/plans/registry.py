"""All queries of the engine itself, with the SQL that they are held against."""

from rivulet.plans import more, replays  # noqa: F401  (they register their queries)
from rivulet.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
