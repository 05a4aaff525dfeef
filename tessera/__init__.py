"""Small-area index, reporting and benchmark operators on Spark DataFrames."""
