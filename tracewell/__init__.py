"""Spark-native analytics for agent-session event logs."""

__version__ = "0.1.0"
