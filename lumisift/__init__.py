"""Spark-first annotation and vetting of survey detections."""

__version__ = "0.1.0"
