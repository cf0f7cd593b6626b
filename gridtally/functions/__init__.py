"""Column expressions: predicates, scalars, intervals and measures."""
