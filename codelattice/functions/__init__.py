"""Column functions: text, vectors and ranking measures."""
