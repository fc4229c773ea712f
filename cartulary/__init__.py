"""A Spark-first analytics engine for territorial decision support."""
