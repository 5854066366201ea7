"""Draw-history analytics on PySpark."""
