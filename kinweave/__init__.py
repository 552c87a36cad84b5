"""kinweave: identity resolution and tabular analytics as lazy Spark DataFrame operators."""
