"""Ready-made queries over the given tables, each with the SQL it must agree with."""

from docloom.plans.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
