"""Reconciliation of two copies of a table, as Spark jobs."""
