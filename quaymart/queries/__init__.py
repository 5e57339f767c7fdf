"""Registered queries and the SQL that checks them."""

from .registry import CHECKS, QUERIES  # noqa: F401
from . import supply, forecast, diagnose, clean, label, index, stream  # noqa: F401,E402
