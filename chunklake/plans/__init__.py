"""plans of chunklake."""
