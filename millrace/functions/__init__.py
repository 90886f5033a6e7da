"""Column-level helpers: names, text, predicates, casts."""
