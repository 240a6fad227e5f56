"""Inventory and purchasing analytics as DataFrame -> DataFrame functions on Spark."""

from granary.session import build_session

__all__ = ["build_session"]
