"""Column helpers, predicates and the pattern language."""
