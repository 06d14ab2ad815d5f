"""Spark-first sequencing-data simulation, model fitting and corpus processing."""
