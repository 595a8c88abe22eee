"""Column functions: predicates, text and geo."""
