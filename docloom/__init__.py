"""Document analytics on Spark: every operator is a Column or DataFrame transform."""

__version__ = "0.1.0"
