"""streaming of chunklake."""
