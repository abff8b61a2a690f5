"""Discussion-site activity analytics as Spark DataFrame jobs."""
