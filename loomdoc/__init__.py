"""Document and schema analytics expressed as Spark DataFrame jobs."""
