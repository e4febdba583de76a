"""Dataset-to-dataset operators: last-writer-wins views, reads, merges and checks."""
