"""Kinloom: mixed-script entity resolution and corpus preparation on Spark."""

__version__ = "0.1.0"
