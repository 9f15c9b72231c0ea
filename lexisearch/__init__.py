"""A full-text search and ranking engine on PySpark."""
