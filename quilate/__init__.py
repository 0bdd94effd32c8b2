"""Price-intelligence operators for Spark: plain ``DataFrame -> DataFrame`` functions."""

__version__ = "0.1.0"
