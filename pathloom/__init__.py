"""Set-at-a-time routing analytics on PySpark DataFrames."""
