"""strataspark: Spark operators over code corpora, documentation records and text."""
