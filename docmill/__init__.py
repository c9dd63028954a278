"""Document processing and operational analytics on PySpark DataFrames."""
