"""Column functions: vectors, tokens, display."""
