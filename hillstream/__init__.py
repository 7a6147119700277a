"""Spark-first analytics for telemetry extracted from recorded matches."""
