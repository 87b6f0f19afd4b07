"""All queries by name, with their SQL where SQL can express them."""

from __future__ import annotations

from . import event_queries, model_queries  # noqa: F401  (each registers its queries)
from .base import QUERIES, SQL  # noqa: F401

FLAGSHIP = "q_w2_prefixes"
