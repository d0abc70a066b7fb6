"""Support-ticket analytics as Spark jobs."""
