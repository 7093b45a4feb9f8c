"""Wiki-corpus catalogue, link-graph and asset tables as Spark DataFrames."""
