"""Column functions: text, coercion, vectors and question rules."""
