"""Imports every query module so the registry is complete."""

from riskflow.plans import flagship, q_charges, q_core, q_forest, q_models, q_monitor, q_retention  # noqa: F401
from riskflow.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
