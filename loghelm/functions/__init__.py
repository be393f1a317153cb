"""Column functions: grammars, predicates and projections of single facts."""
