"""Column functions: text as Python treats it, predicates on cells, tokens, properties."""
