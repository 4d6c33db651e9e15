"""All registered queries. Importing the modules registers them."""

from assay.plans import (  # noqa: F401
    corruption_queries,
    history_queries,
    response_queries,
    rule_queries,
    ruleset_queries,
    source_queries,
    stream_queries,
)
from assay.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
