"""Document tables, filters, aggregates, change logs and snapshots as Spark DataFrame operations."""
