"""Registered queries over the driver's tables."""

from . import box_queries, frame_queries, image_queries, store_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
