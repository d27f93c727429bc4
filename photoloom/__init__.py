"""photoloom: a Spark-native engine for photometry tables and the corpora around them."""

__version__ = "0.1.0"
