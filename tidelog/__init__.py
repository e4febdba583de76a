"""A durable, ordered key-value log on Spark: every read is a last-writer-wins view of appended operations."""
