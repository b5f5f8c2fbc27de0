"""Registered queries; importing the sections fills the registry."""

from . import analytics_, functions_, pages_, quality_, resolution_, streams_  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
