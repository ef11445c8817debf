"""orebase: typed object models, access paths and set-level writes on Spark DataFrames."""
