"""Importing this module registers all of the engine's own queries."""

from .functions import blocks, classify, dates, page_tables, records, resolve, text, urls  # noqa: F401
from .operators import aggregates, audit, audits, changes, dedup, evaluate, extraction, filters, groups, merging, more, ranking  # noqa: F401
from .plans import nlq  # noqa: F401
from .streaming import ingest, sync  # noqa: F401
