"""Astronomical images as relations, on Spark."""
