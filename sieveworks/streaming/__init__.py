"""streaming of sieveworks."""
