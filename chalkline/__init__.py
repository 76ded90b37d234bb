"""School analytics as Spark DataFrame transformations."""
