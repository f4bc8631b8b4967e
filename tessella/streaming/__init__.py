"""Row callbacks with hooks, and declared aggregations over streams of files."""
