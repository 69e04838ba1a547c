"""Column functions over sequences, taxa and numbers: plain Catalyst expressions, no Python in the plan."""
