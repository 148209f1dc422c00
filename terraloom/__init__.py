"""Area-of-interest geospatial ingestion and analysis on PySpark DataFrames."""

__version__ = "0.1.0"
