"""Documentation analytics as lazy Spark DataFrame pipelines."""
