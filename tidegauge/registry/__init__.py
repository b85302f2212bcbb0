"""Every registered query with its check SQL."""

from .base import REGISTRY
from . import factors, quality, regime, scoring, events, advisory, serving, ingest, live  # noqa: F401

__all__ = ["REGISTRY"]
