"""All registered queries of the core library and their SQL: importing the modules registers them."""

from __future__ import annotations

from . import queries, queries_merge, queries_visual  # noqa: F401
from .queries import ORACLE_SQL, QUERIES  # noqa: F401
