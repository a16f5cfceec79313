"""Web-page extraction and crawl analytics expressed as Spark DataFrames."""
