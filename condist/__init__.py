"""Anomaly detection with conditional distributions, as Spark jobs."""
