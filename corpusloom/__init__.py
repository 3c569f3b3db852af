"""Document-corpus analytics as Spark DataFrame functions."""
