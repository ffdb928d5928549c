"""sources of chunklake."""
