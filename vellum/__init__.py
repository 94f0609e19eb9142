"""Document analytics on Spark: DataFrame-first operators over documents, pages and their structure."""
