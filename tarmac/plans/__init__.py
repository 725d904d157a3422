"""Prepared feature table and the query catalog."""
