"""Text of a query to its syntax tree."""
