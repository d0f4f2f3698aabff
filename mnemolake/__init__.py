"""Document-memory analytics on Spark: ingest, search, enrich, protect, remember, maintain."""
