"""A dataset algebra, its analytics queries and its stages, as Spark DataFrame plans."""
