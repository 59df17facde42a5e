"""sources of sieveworks."""
