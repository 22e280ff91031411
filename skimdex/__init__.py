"""A PySpark-native secondary-index and data-skipping engine."""

from .session import Engine, Table

__all__ = ["Engine", "Table"]
