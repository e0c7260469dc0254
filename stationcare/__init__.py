"""Predictive-maintenance analytics for fluid-filling stations, on Spark."""

__version__ = "0.1.0"
