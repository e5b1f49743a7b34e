"""Crawl, index, rank and search over web-style corpora as Spark DataFrame plans."""
