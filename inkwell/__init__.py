"""inkwell: ingest, deduplicate, query and rank collections of articles with PySpark."""
