"""Document and reading analytics as Spark jobs."""
