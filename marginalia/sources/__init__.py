"""Where postings come from: a scan of a table, or an index of Parquet segments."""
