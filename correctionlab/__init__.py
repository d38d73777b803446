"""Human-in-the-loop correction analytics as Spark DataFrame jobs."""
