"""Column builders: text normalisers and two-valued predicates."""
