"""Segment, descriptor, raster and graph analytics as Spark DataFrame operations."""
