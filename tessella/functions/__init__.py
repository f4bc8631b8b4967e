"""Column functions for ranges, JSON documents, arrays, text search and scalars; all are built-in expressions but one."""
