"""tallow: candlestick analytics as lazy Spark plans, and operators for text corpora."""
