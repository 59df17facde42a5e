"""operators of sieveworks."""
