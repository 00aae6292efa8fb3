"""Routing analytics over per-query, per-candidate outcomes, as Spark DataFrame jobs."""
