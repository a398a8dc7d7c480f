"""graphloom: structural graph analytics on PySpark DataFrames."""
