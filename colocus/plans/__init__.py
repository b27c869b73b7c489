"""The registered queries, one module for each family."""

from colocus.plans import etl, models, sources, spatial, typing  # noqa: F401
from colocus.plans.registry import ORACLES, QUERIES  # noqa: F401
