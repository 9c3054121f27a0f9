"""Column functions: text predicates and the token cascade."""
