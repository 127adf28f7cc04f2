"""Column functions: text, vectors. All are built-in expressions, so they stay in generated code."""
