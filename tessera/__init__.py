"""tessera: catalogue analytics as plain Spark DataFrame operators."""
