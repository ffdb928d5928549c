"""functions of chunklake."""
