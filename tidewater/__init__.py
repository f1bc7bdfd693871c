"""Point-in-time market analytics on Spark: DataFrame and SQL first."""
