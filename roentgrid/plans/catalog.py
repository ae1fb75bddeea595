"""All registered queries."""

from . import (  # noqa: F401
    box_queries,
    instance_queries,
    io_queries,
    join_queries,
    labelling_queries,
    metric_queries,
    sampling_queries,
    text_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
