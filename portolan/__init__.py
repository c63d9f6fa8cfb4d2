"""Import-risk and privacy analytics as Spark DataFrame operators."""
