"""Telemetry analytics as Spark DataFrame operators."""
