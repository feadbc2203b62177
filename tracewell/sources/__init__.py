"""Readers of event logs and adapters of other tables."""
