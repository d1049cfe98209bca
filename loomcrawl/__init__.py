"""loomcrawl: a PySpark-native analytics engine for web-crawl data."""

__version__ = "0.1.0"
