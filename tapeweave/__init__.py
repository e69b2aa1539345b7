"""Market time series, news and trade analytics as distributed Spark plans."""
