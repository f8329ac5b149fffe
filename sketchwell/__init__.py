"""Approximate analytics on Spark tables and streams."""
