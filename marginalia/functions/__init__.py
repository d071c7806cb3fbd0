"""Column functions over text, JSON and vectors."""
