"""Queries over the given tables, each with the SQL that states the expected result."""

from . import detail, domain, relational, series  # noqa: F401  (registration)
from .base import REGISTRY  # noqa: F401
