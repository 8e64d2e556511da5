"""Column-level building blocks: fixed values, text, scores and JSON coercion."""
