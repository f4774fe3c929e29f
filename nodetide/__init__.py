"""Telemetry forecasting and scaling decisions for machine clusters, on Spark."""
