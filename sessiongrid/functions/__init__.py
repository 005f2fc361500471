"""Column functions: every one takes and returns ``pyspark.sql.Column``."""
