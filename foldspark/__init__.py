"""foldspark: leakage-free analytics over large categorical tables, on Spark."""
