"""Flood-situation analytics as PySpark DataFrame, SQL and Structured Streaming operators."""
