"""Source-code graph analytics on PySpark."""
