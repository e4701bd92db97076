"""Object-catalogue analytics on PySpark."""
