"""All registered queries but those of the training-data operators."""

from __future__ import annotations

from . import answer_queries, corpus_queries, stream_queries  # noqa: F401  they register themselves
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
