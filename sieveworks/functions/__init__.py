"""Column functions: pure expressions, no session and no action."""
