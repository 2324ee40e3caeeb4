"""Imports every query module, so that the registry is complete."""

from threadloom.plans import profiles, retrieval, routing, samples, scores, texts, threads  # noqa: F401
from threadloom.plans.registry import ORACLES, QUERIES  # noqa: F401
