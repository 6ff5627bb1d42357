"""Documentation retrieval and analytics expressed as Spark plans."""
