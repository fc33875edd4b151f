"""Code-graph and documentation analytics as Spark DataFrame jobs."""
