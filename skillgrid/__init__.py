"""Labour-market and curriculum analytics on PySpark."""
