"""Column helpers built from pyspark.sql.functions only."""
