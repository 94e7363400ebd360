"""Document-library analytics expressed as Spark DataFrame jobs."""
