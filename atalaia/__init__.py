"""Document-governance analytics on PySpark."""
