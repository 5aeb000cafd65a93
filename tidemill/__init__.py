"""Site capture analytics on Spark: URL, page, asset and crawl operators as DataFrame plans."""
