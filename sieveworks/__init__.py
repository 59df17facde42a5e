"""sieveworks: evidence-gated analytics over semi-structured documents, on Spark."""
