"""All named queries with their oracle SQL."""

from driftspark.catalog import distances, flows, models, samples, scoring, streams, tables  # noqa: F401
from driftspark.catalog.base import ORACLES, QUERIES  # noqa: F401
