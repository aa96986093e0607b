"""tidepane: a Spark-native engine for labelled time series and their event data."""

__version__ = "0.1.0"
