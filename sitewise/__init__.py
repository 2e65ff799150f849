"""Geographic access and facility-siting analytics as plain PySpark DataFrames."""
