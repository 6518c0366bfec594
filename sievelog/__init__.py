"""Log analytics operators for Spark: every operator is a DataFrame -> DataFrame function."""
