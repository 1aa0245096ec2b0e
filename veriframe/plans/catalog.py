"""Imports every query module so that the registry is complete."""

from veriframe.plans import (  # noqa: F401
    candidate_queries,
    chain_queries,
    community_queries,
    dedup_queries,
    resolve_queries,
    scoring_queries,
    source_queries,
    stream_queries,
    text_queries,
)
from veriframe.plans.registry import ORACLES, QUERIES  # noqa: F401
