"""Relations over source repositories and their HTTP routes, as Spark DataFrames."""
