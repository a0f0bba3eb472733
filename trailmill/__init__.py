"""Session analytics on Spark: DataFrame operators for e-commerce clickstreams."""

__version__ = "0.1.0"
