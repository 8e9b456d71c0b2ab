"""engram: build, maintain and search a long-term memory with PySpark."""
