"""Freight and cargo analytics as Spark jobs."""
