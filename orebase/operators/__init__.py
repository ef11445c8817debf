"""Access paths and set-level operators on DataFrames."""
