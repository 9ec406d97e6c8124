"""Barcode consensus and read-set processing on Spark DataFrames."""

__version__ = "0.1.0"
