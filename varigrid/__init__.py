"""varigrid: small-variant analytics on Spark DataFrames."""
