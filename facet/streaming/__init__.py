"""Statements over streams."""

from .watch import watch

__all__ = ["watch"]
