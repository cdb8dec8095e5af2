"""quadloom: Web-Mercator tile pyramids as Spark DataFrames."""
