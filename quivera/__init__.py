"""quivera: property-graph analytics on Spark DataFrames."""
