"""Column-level helpers built on `pyspark.sql.functions`."""
