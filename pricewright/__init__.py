"""Retail price and entity-resolution analytics as Spark DataFrame jobs."""
