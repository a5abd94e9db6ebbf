"""Document inventory, entity matching and label evaluation as Spark DataFrame operators."""
