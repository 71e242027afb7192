"""Media-library analytics as Spark DataFrame plans."""
