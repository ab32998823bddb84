"""linework: log, table and document analytics as functions over Spark DataFrames."""
