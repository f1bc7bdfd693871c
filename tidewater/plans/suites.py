"""Importing this module registers every suite of queries."""

from . import analytics, market, platform, research, trading  # noqa: F401
