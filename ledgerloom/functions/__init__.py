"""Column functions: the reference grammar, fixed vocabularies, document helpers."""
