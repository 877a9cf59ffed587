"""Sensor-telemetry forecasting and evaluation on Spark DataFrames."""

from gridcast.spec import SeriesSpec

__all__ = ["SeriesSpec"]
