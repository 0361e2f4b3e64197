"""spanloom: span analytics over annotated text, as Spark DataFrame operators."""
