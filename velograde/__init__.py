"""Road-profile coasting analytics on PySpark."""
