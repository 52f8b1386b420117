"""Content-intelligence analytics as Spark DataFrame operators."""
