"""Column expressions: framing, hashes, byte accounting and percentiles."""
