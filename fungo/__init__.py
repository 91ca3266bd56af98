"""Point-in-time sports and market analytics as Spark DataFrame jobs."""
