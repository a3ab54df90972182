"""lodestack: document retrieval and analytics expressed as Spark DataFrames."""
