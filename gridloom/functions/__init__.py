"""Column functions: cleaning, labels, parameter keys and statistics."""
