"""All queries of the library's own operators."""

from __future__ import annotations

from loomshift.plans import mutable, relational, surface  # noqa: F401  they register their queries
from loomshift.plans.registry import REGISTRY

QUERIES = REGISTRY
