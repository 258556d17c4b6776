"""A SQL and data-processing engine expressed in PySpark DataFrames."""
