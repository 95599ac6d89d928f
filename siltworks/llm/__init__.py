"""Operators for training-data pipelines. Nothing outside this folder imports it, but for `__spark_entry__`."""
