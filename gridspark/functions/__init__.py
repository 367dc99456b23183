"""Column functions on elements and fixed vectors."""
