"""Analysis and optimisation of Parquet layout on Spark."""
