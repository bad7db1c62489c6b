"""Spark-first threat-event analytics, with training-data operators in the ``llm`` subpackage."""
