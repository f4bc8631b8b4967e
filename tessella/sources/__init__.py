"""Where rows come from and go to: Parquet, JDBC, views and functions, cached results, shards."""
