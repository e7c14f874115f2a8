"""Secret and personal-data analytics on Spark: sources, scans, hits, curation, redaction."""
