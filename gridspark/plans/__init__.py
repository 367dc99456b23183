"""Ready-made queries and pipelines over arrays."""
