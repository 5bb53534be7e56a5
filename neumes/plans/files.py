"""Folders for what queries write and read back."""

from neumes.sources.tables import scratch

__all__ = ["scratch"]
