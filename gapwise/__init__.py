"""gapwise: facility-access and survey analytics as Spark DataFrame operators."""
