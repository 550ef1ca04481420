"""Column functions: statistics, sequences, call records."""
