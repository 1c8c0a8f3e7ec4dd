"""All registered queries: importing the modules registers them."""

from propense.plans import (  # noqa: F401
    featuring,
    ingest,
    labelling,
    measuring,
    modelling,
    ranking,
    splitting,
    storing,
)
from propense.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
