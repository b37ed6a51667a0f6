"""Column expressions: vectors, text, splitting, evaluation, layouts."""
