"""plans of sieveworks."""
