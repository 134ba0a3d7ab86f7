"""Versioned-table analytics on Spark: snapshots, diffs, merges, history and a small SQL dialect, all as DataFrame plans."""
