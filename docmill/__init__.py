"""Document analytics on Spark: a declarative document query language compiled to DataFrames."""
