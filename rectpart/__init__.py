"""Rectilinear partitioning of sparse two-dimensional data on Spark."""
