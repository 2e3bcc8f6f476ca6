"""Usage-log analytics as Spark DataFrame operators."""
