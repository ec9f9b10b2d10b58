"""Creator analytics as Spark jobs: captured responses in, clean tables, summaries and metrics out."""
