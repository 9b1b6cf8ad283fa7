"""tierflow: layered dependency-graph rules and training-data operators on Spark DataFrames."""
