"""Verifiable snapshots of ordered key-value data on Spark."""
