"""A corpus analytics engine on PySpark."""
