"""Event-sequence analytics and training-data preparation as plain Spark DataFrame jobs."""
