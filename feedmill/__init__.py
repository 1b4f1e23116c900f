"""Feed-curation analytics as Spark DataFrame and Column functions."""
