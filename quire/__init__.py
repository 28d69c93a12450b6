"""Document-pipeline analytics as Spark DataFrame jobs."""
