"""Column functions: arrays and vectors."""
