"""Wildfire analytics on PySpark: detections, fire danger, perimeters, infrastructure and layer status."""

__version__ = "0.1.0"
