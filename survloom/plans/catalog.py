"""All registered queries: importing this module fills the registry."""

from survloom.plans import features, modelling, survival, tables  # noqa: F401
from survloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
