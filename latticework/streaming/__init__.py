"""Reports kept up to date from a stream of records."""
