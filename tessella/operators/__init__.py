"""Reads and writes over a catalog: queries, aggregations, joins, unions, top-N, recursion, probes and writes."""
