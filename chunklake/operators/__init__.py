"""operators of chunklake."""
