"""Unicode text canonicalisation and analysis as Spark column and DataFrame operations."""
