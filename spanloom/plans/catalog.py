"""Importing this module registers every query of the library itself."""

from spanloom.plans import files, labels, measures, passages, sequential, texts  # noqa: F401
from spanloom.plans.registry import ORACLES, callables

__all__ = ["ORACLES", "callables"]
