"""All registered queries."""

from sievelog.plans import (  # noqa: F401
    queries_detect, queries_parse, queries_analysis, queries_history, queries_forecast, queries_model, queries_misc, queries_stream, queries_adhoc,
)
from sievelog.plans.registry import ORACLES, QUERIES  # noqa: F401
