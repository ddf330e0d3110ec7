from annalist.plans.queries import QUERIES
from annalist.plans.sql import SQL

__all__ = ["QUERIES", "SQL"]
