"""Document retrieval and usage analytics as Spark DataFrame plans."""
