"""Operators for training corpora. Nothing else in the library imports this package."""

from .oracles import ORACLES
from .queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
