"""Spark operators for multi-source search, fetch and answer quality data."""
