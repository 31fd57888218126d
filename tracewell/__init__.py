"""Evidence-preserving telemetry analytics on Spark."""
