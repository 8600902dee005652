"""A thin analytics layer over Spark DataFrames and Catalyst."""
