"""Geometry functions for SQL."""

from stridewise.functions.register import register_functions

__all__ = ["register_functions"]
